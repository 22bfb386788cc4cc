"""Repositories as tables: files, service boundaries, technology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 5 * 1024 * 1024
BOUNDARY_DEPTH = 6

#: Languages by file extension.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".py": "python", ".go": "go", ".rs": "rust", ".swift": "swift", ".cs": "csharp",
}

#: Folders that are never read.
IGNORED = [
    "node_modules", ".git", ".svn", ".hg", "dist", "build", "out", "target", "bin", "obj", "__pycache__", ".pytest_cache", ".mypy_cache",
    ".next", ".nuxt", ".output", ".cache", "coverage", ".nyc_output", "vendor", "Pods", ".gradle", ".idea", ".vscode", "DerivedData", ".build",
]

#: Manifests by priority; the first of a folder names its service's kind.
MANIFESTS = ["package.json", "pom.xml", "build.gradle", "build.gradle.kts", "go.mod", "Cargo.toml", "pyproject.toml", "requirements.txt", "Pipfile", "Package.swift"]


def is_test(path: Column) -> Column:
    """Whether a relative path is that of a test file. A leading tests/ folder doesn't count: only /tests/ inside the path."""
    name = F.substring_index(path, "/", -1)
    return name.rlike(r"\.(test|spec)\.") | name.endswith("_test.go") | name.endswith("_test.py") | name.startswith("test_") | path.rlike("/(test|tests|spec|specs|__tests__|e2e)/")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, content) of all files below root. The size filter is pushed to the reader, before contents are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    raw = raw.where((F.col("length") > 0) & (F.col("length") <= MOST_BYTES))
    # what follows the root in the reader's absolute path
    relative = F.substring_index("path", root.rstrip("/").removeprefix("file://") + "/", -1)
    return raw.select(relative.alias("path"), F.col("length").alias("size"), "content")


#: Extensions of markup in code, which an analysis of services alone leaves out.
FRONTEND = [".tsx", ".jsx"]


def source_files(files: DataFrame, skip_tests: bool = True, extensions: list[str] | None = None, frontend: bool = True) -> DataFrame:
    """(path, extension, language, size, text) of source files: known languages, or of these only the given extensions; no ignored folders, no declarations, bundles or minified code, and no tests. Spark's reader doesn't follow links to folders."""
    path = F.col("path")
    ext = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    language = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    out = files.withColumn("extension", ext).withColumn("language", F.element_at(language, F.col("extension"))).where(F.col("language").isNotNull())
    out = out.where(~path.rlike(r"\.(d\.ts|min\.js|bundle\.js)$")).where(~F.arrays_overlap(F.split(path, "/"), F.lit(IGNORED)))
    if skip_tests:
        out = out.where(~is_test(path))
    if extensions is not None:
        out = out.where(F.col("extension").isin(extensions))
    if not frontend:
        out = out.where(~F.col("extension").isin(FRONTEND))
    return out.select("path", "extension", "language", "size", F.decode("content", "UTF-8").alias("text"))


def boundaries(files: DataFrame) -> DataFrame:
    """(root, manifest): folders with a manifest, at most BOUNDARY_DEPTH deep, by the first manifest in priority; the whole repository ('' and docker) if there is none."""
    name, folder = F.substring_index("path", "/", -1), F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    rank = F.array_position(F.lit(MANIFESTS), name)
    depth = F.when(folder == "", 0).otherwise(F.size(F.split(folder, "/")))
    found = files.select(folder.alias("root"), rank.alias("rank"), name.alias("manifest"), depth.alias("depth")).where((F.col("rank") > 0) & (F.col("depth") <= BOUNDARY_DEPTH))
    found = found.where(~F.arrays_overlap(F.split("root", "/"), F.lit(IGNORED))).groupBy("root").agg(F.min_by("manifest", "rank").alias("manifest"))
    any_found = found.agg(F.count(F.lit(1)).alias("n"))
    return found.unionByName(any_found.where("n = 0").select(F.lit("").alias("root"), F.lit("docker").alias("manifest")))


def assign(files: DataFrame, found: DataFrame) -> DataFrame:
    """files with service, one row for every boundary around a file: nested boundaries each have it. An equi join of each folder above a file.

    Boundaries, a short row for each folder with a manifest, are sent to the files, so
    that texts aren't shuffled, and no task gets all files of a service.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.withColumn("service", F.explode(above)).join(F.broadcast(found.select(F.col("root").alias("service"), "manifest")), "service")


#: Marks of frameworks in manifests, the first that matches; and of databases and brokers, all that match.
FRAMEWORKS = [("nestjs", "@nestjs/core"), ("fastify", '"fastify"'), ("express", '"express"'), ("spring", "spring-boot"), ("fastapi", "fastapi"), ("django", "django"), ("flask", "flask"), ("gin", "gin-gonic"), ("echo", "labstack/echo"), ("chi", "go-chi"), ("actix", "actix-web"), ("axum", "axum"), ("vapor", "vapor")]
HINTS = [("postgres", "database", r"postgres|\"pg\"|psycopg|lib/pq"), ("mysql", "database", r"mysql"), ("mongodb", "database", r"mongo"), ("redis", "database", r"redis"), ("sqlite", "database", r"sqlite"), ("kafka", "broker", r"kafka|sarama"), ("rabbitmq", "broker", r"amqp|pika|rabbit"), ("nats", "broker", r"nats")]


def stacks(files: DataFrame, found: DataFrame) -> DataFrame:
    """(service, framework, hints): the first framework and all database and broker hints in a service's manifests."""
    name = F.substring_index("path", "/", -1)
    text = assign(files.where(name.isin(MANIFESTS + [".env", "go.sum"])), found).select("service", F.lower(F.decode("content", "UTF-8")).alias("text"), F.regexp_replace("path", "/?[^/]*$", "").alias("folder")).where("folder = service")
    first = F
    for framework, mark in FRAMEWORKS:
        first = first.when(F.col("all").contains(mark), framework)
    hints = F.array_compact(F.array(*[F.when(F.col("all").rlike(p), F.struct(F.lit(n).alias("engine"), F.lit(k).alias("kind"))) for n, k, p in HINTS]))
    # a handful of manifests a service
    joined = text.groupBy("service").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("all"))
    return found.select(F.col("root").alias("service")).join(joined.select("service", first.otherwise("unknown").alias("framework"), hints.alias("hints")), "service", "left").select("service", F.coalesce("framework", F.lit("unknown")).alias("framework"), "hints")

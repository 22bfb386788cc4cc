"""A small shop in four languages, and what must be found in its files, written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import links, validate
from graphloom.plans import analysis
from graphloom.saved import Saved

CASES = {}


def query(sql: str):
    def put(f):
        CASES[f.__name__] = (f, sql)
        return f

    return put

FILES = {
    "users/requirements.txt": "fastapi\nsqlalchemy\n",
    "users/app.py": '''
from fastapi import FastAPI
app = FastAPI()

class User(Base):
    __tablename__ = "users"
    id = Column(Integer, primary_key=True)
    email = Column(String)

@app.get("/users/{user_id}")
async def get_user(user_id: int):
    logger.info("loading user")
    try:
        return load(user_id)
    except NotFound:
        raise HTTPException(status_code=404)

@app.post("/users")
def add_user(user):
    session.add(user)
    producer.send("user.created", user)
    return user

def load(user_id):
    if user_id < 0:
        raise ValidationError("bad")
    return session.query(User).first()
''',
    "orders/pom.xml": "<artifactId>spring-boot</artifactId>",
    "orders/src/OrderController.java": '''
@RestController
@RequestMapping("/orders")
public class OrderController {
  @GetMapping("/{id}")
  public Order find(Long id) {
    log.info("find");
    return orderRepository.findByUserId(id);
  }
  @KafkaListener(topics = "user.created", groupId = "g")
  public void created(String s) { kafkaTemplate.send("order.placed", s); }
}
@FeignClient(name = "users", url = "http://users")
interface UserClient {
  @GetMapping("/users/{id}")
  User find(Long id);
}
''',
    "stock/go.mod": "module stock\n",
    "stock/main.go": '''
package main
type Item struct {
  gorm.Model
  Sku string `gorm:"unique"`
}
func (s *Server) List(c *gin.Context) {
  if c == nil { panic("nil") }
  s.db.Find(&items)
}
func main() {
  v1 := r.Group("/v1")
  v1.GET("/stock/:sku", s.List)
}
''',
    "web/package.json": '{"dependencies": {"react": "18"}}',
    "web/src/pages/CartPage.tsx": '''
import React from "react";
export default function CartPage() {
  const buy = () => { fetch("/orders/1"); };
  return <CartList onClick={buy} />;
}
export const CartList = ({ items }) => {
  return <ul onClick={pick}>{items}</ul>;
};
''',
    "users/test_app.py": "def test(): pass",
}


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, len(t), bytearray(t.encode())) for p, t in FILES.items()], "path string, size long, content binary")


def _nodes(spark):
    return analysis.nodes_of(files(spark))


def values(columns: str, *rows: tuple) -> str:
    """SQL of a table with these rows."""
    cell = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({columns})"


@query(values("service, method, path", ("users", "GET", "/users/{user_id}"), ("users", "POST", "/users"), ("orders", "GET", "/orders/{id}"), ("stock", "GET", "/v1/stock/:sku")))
def example_endpoints(spark, d):
    """EP-2, EP-4, EP-6, EP-8 from files."""
    return _nodes(spark).where("type = 'endpoint'").select("service", F.col("kind").alias("method"), F.col("meta")["path"].alias("path"))


@query(values("topic, service, role", ("user.created", "users", "publish"), ("user.created", "orders", "consume"), ("order.placed", "orders", "publish")))
def example_topics(spark, d):
    """EV-2, EV-3 from files."""
    return _nodes(spark).where("type = 'event'").select(F.col("name").alias("topic"), "service", F.col("kind").alias("role")).distinct()


@query(values("service, entity, name, key", ("users", "User", "id", True), ("users", "User", "email", False), ("stock", "Item", "sku", False)))
def example_columns(spark, d):
    """DB-5, DB-6 from files."""
    return _nodes(spark).where("type = 'column'").select("service", F.col("meta")["entity"].alias("entity"), "name", (F.col("meta")["primaryKey"] == "true").alias("key"))


@query(values("service, error, status", ("users", "HTTPException", 404), ("users", "ValidationError", 400), ("stock", "panic", 500)))
def example_throws(spark, d):
    """FL-2, FL-3, FL-4, FL-7 from files."""
    return _nodes(spark).where("type = 'throw'").select("service", F.col("name").alias("error"), F.col("meta")["status"].cast("int").alias("status"))


@query(values("caller, method, path, target, confidence", ("orders", "GET", "/users/:param", "users", 10)).replace("* FROM", "caller, method, path, target, CAST(confidence / 10.0 AS DOUBLE) AS confidence FROM"))
def example_resolution(spark, d):
    """HC-3, JN-14, RS-1: a call of one service to an endpoint of another that is named in its address."""
    out = analysis.cross_service(_nodes(spark)).where("service <> 'web'")
    return out.select(F.col("service").alias("caller"), "method", "path", F.col("target_service").alias("target"), "confidence")


@query(values("name, type, parent", ("load", "call", "try"), ("session.query", "call", "load"), ("ValidationError", "throw", "if"), ("producer.send", "call", "add_user"), ("HTTPException", "throw", "catch")))
def example_nesting(spark, d):
    """JN-1, JN-2 from files: some nodes with what holds them."""
    n = analysis.nested(_nodes(spark)).where("service = 'users'")
    up = n.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"), F.col("type").alias("up_type")).distinct()
    hit = n.join(up, "parent_id").where("(type = 'call' and name in ('load', 'session.query', 'producer.send')) or type = 'throw'")
    return hit.select("name", "type", "parent").distinct()


@query(values("source, target, kind", ("GET /users/{user_id}", "get_user", "calls"), ("POST /users", "add_user", "calls"), ("get_user", "load", "calls"), ("add_user", "database:users", "writes_to"), ("load", "database:users", "reads_from"), ("service:users", "topic:user.created", "publishes_to")))
def example_edges(spark, d):
    """JN-3, JN-5, JN-6, JN-10 from files: the edges of one service."""
    n = _nodes(spark).where("service = 'users'")
    label = F.when(F.col("type") == "endpoint", F.concat("kind", F.lit(" "), F.col("meta")["path"])).otherwise(F.col("name"))
    names = n.where("type in ('endpoint', 'function')").select("id", label.alias("label"))
    e = analysis.derived_edges(n).where("kind <> 'calls' or source <> target")
    named = lambda c: names.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    out = e.join(named("source"), "source", "left").join(named("target"), "target", "left")
    return out.select(F.coalesce("source_label", "source").alias("source"), F.coalesce("target_label", "target").alias("target"), "kind")


@query(values("screen, route, component", ("CartPage", "/cart", "CartList")))
def example_screens(spark, d):
    """FE-1, FE-4, JN-17 from files."""
    t = analysis.topology_of(files(spark).where("path like 'web/%'"), Saved(spark).save)
    s, c = t["screens"], t["components"].unionByName(t["screens"].select("id", "service_id", "name", F.lit("screen").alias("kind"), F.lit(0).cast("long").alias("ord")))
    hit = links.components(s, c)
    return hit.join(s.select(F.col("id").alias("screen"), F.col("name").alias("s_name"), "route"), "screen").join(c.select(F.col("id").alias("component"), F.col("name").alias("c_name")), "component").select(F.col("s_name").alias("screen"), "route", F.col("c_name").alias("component")).where("screen <> component")


@query("SELECT '' AS service, '' AS path WHERE false")
def example_stubs(spark, d):
    """VL-21 from files: every route has a handler, one of them named by an argument only."""
    n = _nodes(spark)
    ends = n.where("type = 'endpoint'").select("id", "service", F.col("kind").alias("method"), F.col("meta")["path"].alias("path"))
    found = validate.stubs(ends, analysis.derived_edges(n))
    return ends.join(found.select(F.col("node").alias("id")), "id").select("service", "path")

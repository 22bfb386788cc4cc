"""What the rules of the parse layer find, language by language."""

from graphloom.sources import parse

JAVA = '''
@Entity(name = "orders")
public class Order {
  @Id
  private Long id;
  @Column(name = "user_id", unique = true)
  private Long userId;
  private Date createdAt;
}
@FeignClient(name = "stock", url = "http://stock")
interface StockClient {
  @GetMapping("/stock/{sku}")
  Stock find(String sku);
  @PostMapping("/stock")
  Stock add(Stock s);
}
class Listener {
  @KafkaListener(topics = "order.placed", groupId = "g")
  public void placed(String s) { orderRepository.findByUserId(1); publisher.publishEvent(new Placed(s)); }
  @WithSpan
  public void traced() { orderRepository.deleteByAge(3); }
}
'''

GO = '''
type User struct {
  gorm.Model
  Name string `gorm:"column:full_name;unique"`
  Email string `gorm:"unique"`
}
func routes() {
  api := r.Group("/api")
  v1 := api.Group("/v1")
  v1.GET("/users/:id", show)
  r.POST("/plain", make)
}
'''

TSX = '''
import React, { useState } from "react";
export default function CartPage() {
  const [items, setItems] = useState([]);
  const handleBuy = async () => {
    await fetch("/api/buy");
  };
  return <Layout><CartList items={items} /><button onClick={handleBuy}>buy</button><a onClick={() => setItems}>x</a></Layout>;
}
export const CartList = ({ items }) => {
  return <ul>{items.map(i => <li>{i}</li>)}</ul>;
};
const helper = (x) => { return x; };
'''

TS = '''
type Id = string;
export const LIMIT = 5;
server.route({ method: ["GET", "POST"], url: "/things/:id", handler });
export class A {
  run() {
    const span = tracer.startSpan("work");
    meter.createCounter("n");
    this.count += 1;
    // tracer.startSpan("comment")
    return res.status(201).json({ a: 1 });
  }
}
'''


def of(language, text, path=""):
    return parse.brace_nodes(language, text, path)


def test_java():
    n = of("java", JAVA)
    assert {(x.name, x.meta["path"], x.meta["baseUrl"]) for x in n if x.type == "externalCall"} == {("GET /stock/{sku}", "/stock/{sku}", "http://stock"), ("POST /stock", "/stock", "http://stock")}
    assert [(x.name, x.meta["hasTimestamps"]) for x in n if x.type == "table"] == [("orders", "true")]
    assert {(x.name, x.kind, x.meta["primaryKey"], x.meta["unique"]) for x in n if x.type == "column"} == {("id", "Long", "true", "false"), ("user_id", "Long", "false", "true")}
    assert {(x.name, x.kind) for x in n if x.type == "event"} == {("order.placed", "consume"), ("Placed", "publish")}
    assert [x.kind for x in n if x.type == "telemetry"] == ["span"]
    assert {x.meta["operation"] for x in n if x.type == "dbProcess"} == {"findMany", "deleteMany"}


def test_go():
    n = of("go", GO)
    assert {(x.kind, x.meta["path"]) for x in n if x.type == "endpoint"} == {("GET", "/api/v1/users/:id"), ("POST", "/plain")}
    assert [(x.name, x.meta["hasSoftDelete"]) for x in n if x.type == "table"] == [("users", "true")]
    assert {(x.name, x.meta["unique"]) for x in n if x.type == "column"} == {("full_name", "true"), ("email", "true")}


def test_frontend():
    n = of("typescript", TSX, "src/pages/CartPage.tsx")
    screens = {x.name: x for x in n if x.type == "screen"}
    assert screens["CartPage"].meta["route"] == "/cart" and screens["CartPage"].meta["state"] == "items" and screens["CartPage"].meta["references"] == "Layout,CartList" and screens["CartPage"].meta["hooks"] == "useState"
    assert {(x.name, x.kind, x.meta["action"]) for x in n if x.type == "frontendEvent"} == {("handleBuy", "click", "api_call"), ("setItems", "click", "state_update")}
    only = of("typescript", TSX, "src/components/cart.tsx")
    assert {(x.name, x.kind) for x in only if x.type == "component"} == {("CartList", "list")} and not [x for x in of("typescript", TSX, "src/cart.ts") if x.type == "screen"]


def test_typescript():
    n = of("typescript", TS)
    assert {(x.kind, x.meta["path"]) for x in n if x.type == "endpoint"} == {("GET", "/things/:id"), ("POST", "/things/:id")}
    assert {(x.name, x.kind) for x in n if x.type == "telemetry"} == {("work", "span"), ("Counter", "metric")}
    assert {(x.name, x.kind) for x in n if x.type == "data"} >= {("Id", "type"), ("LIMIT", "const")}
    assert {(x.name, x.kind) for x in n if x.type == "process"} >= {("this.count", "+=")}
    assert [(x.meta.get("status"), x.meta.get("responseType")) for x in n if x.type == "return"] == [("201", "json")]

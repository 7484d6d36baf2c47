"""Facts read from source code."""

import pytest

from loomgrain.sources import code

RUST = '''
use axum::{routing::{get, post}, Router};
// fn commented(x) { call_nothing(); }
#[derive(Debug, FromRow)]
pub struct User { id: i64 }
pub struct Plain { name: &'static str }

pub fn app() -> Router {
    Router::new().route("/users/:id", get(show_user).delete(handlers::drop_user)).route("/users", post(make_user))
}
async fn show_user(id: Path<i64>) -> Json<User> {
    info!("show {}", id);
    let s = "helper(1)";
    load::<User>(id).await.unwrap()
}
#[get("/health")]
fn health() { error!("down"); }
#[tokio::main]
async fn main() { serve(app()).await; }
#[test]
fn checks() { assert(helper(2)); warn!("x"); }
pub extern "C" fn exported() {}
fn helper(n: i32) -> bool { n > 1 }
'''
TS = '''
import express from 'express';
const app = express();
/* app.get('/no', nothing) */
@Entity()
export class User { name: string; greet(): string { console.log("hi"); return format(this.name); } }
class Order extends Model {}
app.get('/users', listUsers);
app.post("/users", async (req, res) => { logger.warn('x'); save(req.body); });
export function listUsers(req, res) { try { db.query('f(1)'); } catch (e) { console.error(e); } }
const hidden = (x) => twice(x);
describe('users', () => { it('works', () => { console.info('t'); }); });
'''
PY = '''
import logging
router = APIRouter()
class Item(BaseModel):
    name: str
@dataclass
class Plain: pass
@router.post("/items")
async def make(item):
    logger.error("no")
    return store.save(build(item))
@app.route("/old", methods=["GET", "PUT"])
def old():
    try:
        run()
    except ValueError:
        print("x")
def test_old(): logging.info("t")
def _private(): pass
def main(): old()
'''
SOURCES = {"rust": RUST, "typescript": TS, "python": PY}


def rows(what, language):
    return {tuple(r)[:-1] for r in code.read(what, SOURCES[language], language)}


def test_languages_are_told_apart():
    assert {k: code.language_of(v) for k, v in SOURCES.items()} == {k: k for k in SOURCES}
    assert code.language_of("plain words, nothing else") is None


def test_routes():
    assert rows("routes", "rust") == {("GET", "/users/:id", "show_user", "axum"), ("DELETE", "/users/:id", "drop_user", "axum"), ("POST", "/users", "make_user", "axum"), ("GET", "/health", "health", "attribute")}
    assert rows("routes", "typescript") == {("GET", "/users", "listUsers", "express"), ("POST", "/users", "anonymous", "express")}
    assert rows("routes", "python") == {("POST", "/items", "make", "fastapi"), ("GET", "/old", "old", "flask"), ("PUT", "/old", "old", "flask")}


def test_models():
    assert rows("models", "rust") == {("User", "struct", "FromRow")}
    assert rows("models", "typescript") == {("User", "class", "@Entity"), ("Order", "class", "extends Model")}
    assert rows("models", "python") == {("Item", "class", "BaseModel"), ("Plain", "class", "dataclass")}
    assert [tuple(r)[:2] for r in code.read("models", "interface A {}\ntype B = string;", "typescript", "src/models/a.ts")] == [("A", "interface"), ("B", "schema")]


def test_calls():
    got = rows("calls", "rust")
    assert {("show_user", "load", "direct"), ("show_user", "unwrap", "method"), ("main", "serve", "direct"), ("main", "app", "direct"), ("checks", "helper", "direct"), ("app", "new", "scoped"), ("app", "route", "method")} <= got
    assert not {c for _, c, _ in got} & {"commented", "call_nothing", "fn", "info"} and ("show_user", "helper", "direct") not in got
    got = rows("calls", "typescript")
    assert {("listUsers", "query", "method"), ("hidden", "twice", "direct"), ("greet", "format", "direct"), (None, "express", "direct"), (None, "save", "direct")} <= got
    assert not {c for _, c, _ in got} & {"f", "catch", "nothing", "greet"}
    assert rows("calls", "python") >= {("make", "save", "method"), ("make", "build", "direct"), ("main", "old", "direct"), ("old", "run", "direct")}


def test_logging():
    assert rows("logging", "rust") == {("telemetry", "tracing", "info", False), ("telemetry", "tracing", "error", False), ("error", "error!", "error", False), ("telemetry", "tracing", "warn", True)}
    assert rows("logging", "typescript") == {("telemetry", "console", "info", False), ("telemetry", "logger", "warn", False), ("telemetry", "console", "error", False), ("error", "catch", "error", False), ("telemetry", "console", "info", True)}
    assert rows("logging", "python") == {("telemetry", "logger", "error", False), ("telemetry", "print", "info", False), ("error", "except", "error", False), ("telemetry", "logging", "info", True)}


def test_entries():
    assert rows("entries", "rust") == {("app", "PUBLIC_API"), ("show_user", "HANDLER"), ("health", "HANDLER"), ("main", "ENTRYPOINT"), ("checks", "TEST"), ("exported", "FFI"), ("helper", "INTERNAL")}
    assert {("listUsers", "HANDLER"), ("hidden", "INTERNAL")} <= rows("entries", "typescript")
    assert rows("entries", "python") == {("make", "HANDLER"), ("old", "HANDLER"), ("test_old", "TEST"), ("_private", "INTERNAL"), ("main", "ENTRYPOINT")}


@pytest.mark.parametrize("what", ["calls", "routes", "models", "logging", "entries"])
def test_any_text_is_read_or_skipped(spark, what):
    odd = [None, "", "fn (", "fn a(", "function {{{", "def x(:", "}}}", "fn \\u00e9() {", "/* fn a() {", '"', "def a():\\n  pass\\n" * 2000]
    df = spark.createDataFrame(list(enumerate([*odd, *SOURCES.values()])), "doc_id bigint, text string")
    out = code.code_facts(df, "doc_id", "text", what)
    assert {r.language for r in out.collect() if r.doc_id >= len(odd)} == set(SOURCES)

import json

from conftest import same_rows

from rasterlake.llm import tool_calls as tl

KIND = "conv_id long, turn long, kind string, role string, call_id string, name string, arguments string, after string, content string, depth int"


def rows_of(spark, events, schemas=None):
    schemas = schemas if schemas is not None else spark.createDataFrame([("f", "a", "integer", True), ("f", "b", "string", False), ("f", "a", "integer", True)], "name string, arg string, type string, required boolean")
    return tl.link_tool_calls(spark.createDataFrame([(*e, 0) for e in events], KIND), schemas)


def call(conv, turn, i, arguments='{"a":1}', after=None, name="f"):
    return (conv, turn, "call", "user", i, name, arguments, after, None)


def result(conv, turn, i, content="done"):
    return (conv, turn, "result", "assistant", i, None, None, None, content)


def test_order_and_links(spark):
    chain = [call(1, 100 - k, f"c{k}", after=f"c{k - 1}" if k else None) for k in range(40)] + [result(1, k, f"c{k}") for k in range(40)]
    out = sorted(rows_of(spark, chain).collect(), key=lambda r: r.order_key)
    place = {(r.kind, r.call_id): i for i, r in enumerate(out)}
    assert all(r.status == "linked" for r in out)
    for k in range(40):
        assert place["call", f"c{k}"] < place["result", f"c{k}"]
        assert not k or place["call", f"c{k - 1}"] < place["call", f"c{k}"]
    assert {r.call_id: r.depth for r in out if r.kind == "call"} == {f"c{k}": k for k in range(40)}


def test_status(spark):
    events = [call(1, 0, "x"), call(1, 0, "x"), call(1, 5, "x"), result(1, 1, "x"), result(1, 2, "x"), call(1, 3, "pending"), result(1, 4, "orphan"), result(2, 1, "x"), call(None, 0, "x"), call(1, 6, None), call(3, 0, "p", after="q"), call(3, 1, "q", after="p"), call(3, 2, "r", after="p"), call(3, 3, "s", after="unknown"), (1, 9, "message", "system", None, None, None, None, "hi"), (None, None, None, None, None, None, None, None, None)]
    out = rows_of(spark, events).collect()
    assert len(out) == len(events) - 1
    got = sorted(((r.conv_id, r.turn, r.call_id, r.status) for r in out), key=repr)
    want = [(1, 0, "x", "linked"), (1, 5, "x", "duplicate"), (1, 1, "x", "linked"), (1, 2, "x", "duplicate"), (1, 3, "pending", "pending"), (1, 4, "orphan", "orphan"), (2, 1, "x", "orphan"), (None, 0, "x", "no id"), (1, 6, None, "no id"), (3, 0, "p", "cyclic"), (3, 1, "q", "cyclic"), (3, 2, "r", "cyclic"), (3, 3, "s", "pending"), (1, 9, None, "message"), (None, None, None, "message")]
    assert got == sorted(want, key=repr)


def test_validation_and_canonical_json(spark):
    cases = {
        '{"b":"x","a":1}': [],
        '{"a":"1"}': ["type:a"],
        '{"b":2}': ["missing:a", "type:b"],
        '{"a":1.5}': ["type:a"],
        '{"a":null}': ["type:a"],
        '{"a":2,"z":[1,{"y":1,"x":2}]}': ["unknown:z"],
        "[1]": ["not an object"],
        "not json": ["not an object"],
        "": ["not an object"],
    }
    events = [call(i, 0, 'quo"te\n', a) for i, a in enumerate(cases)] + [call(90, 0, "n", None), call(91, 0, "n", "{}", name="g"), call(92, 0, "n", "{}", name=None)]
    out = {r.conv_id: r for r in rows_of(spark, events).collect()}
    for i, (text, errors) in enumerate(cases.items()):
        assert out[i].errors == errors, text
        got = json.loads(out[i].json)
        args = json.loads(text) if errors != ["not an object"] else None
        assert got == {"arguments": args, "id": 'quo"te\n', "name": "f", "role": "assistant", "type": "tool_call"}
        assert out[i].json == json.dumps(got, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert out[90].errors == ["not an object"] and out[91].errors == out[92].errors == ["unknown tool"]
    empty = spark.createDataFrame([], "name string, arg string, type string, required boolean")
    assert rows_of(spark, [call(1, 0, "x")], empty).first().errors == ["unknown tool"]
    assert rows_of(spark, []).count() == 0


def test_hot_ids_names_and_clashes(spark, monkeypatch):
    """Many calls after one call, many results of one id, many of one tool; long texts; schemas too many to broadcast."""
    events = [call(1, 0, "root")] + [call(1, k, f"c{k}", after="root") for k in range(1, 60)] + [result(1, k, "root", f"r{k}") for k in range(60)]
    events += [call(2, 0, "long", '{"a":1,"b":"' + "x" * 300_000 + '"}')]
    schema = spark.createDataFrame([("f", "a", "integer", True, 1), ("f", "b", "string", False, 2)], "name string, arg string, type string, required boolean, ARG int")
    df = spark.createDataFrame([(*e, 1, 2, 3) for e in events], KIND.replace("depth int", "c int, Turn int, _n int"))
    want = None
    for most, hot in ((10_000, 10_000), (0, 10_000), (10_000, 10), (0, 10)):
        monkeypatch.setattr(tl, "BROADCAST_SCHEMAS", most)
        monkeypatch.setattr("rasterlake.llm.common.HOT", hot)
        rows = sorted(map(str, tl.link_tool_calls(df, schema).collect()))
        want = want or rows
        assert rows == want
    out = tl.link_tool_calls(df, schema).collect()
    assert {r.depth for r in out if r.call_id != "root" and r.conv_id == 1} == {1}
    assert sum(r.status == "duplicate" for r in out) == 59 and sum(r.status == "linked" for r in out) == 2
    assert [r.errors for r in out if r.conv_id == 2] == [[]]


def test_query(spark, sf_dir, duck):
    same_rows(tl.op10_tool_call_linking(spark, sf_dir), duck, tl.ORACLE_SQL)


def test_order_of_the_query(spark, sf_dir):
    out = tl.op10_tool_call_linking(spark, sf_dir).collect()
    place = {}
    for r in sorted(out, key=lambda r: (r.conv_id, r.order_key)):
        if r.kind == "call":
            assert r.depth == 0 or place[f"c{r.conv_id}-{r.turn - 2}"] < len(place)
            place[r.call_id] = len(place)
        elif r.status == "linked" and r.kind == "result":
            assert r.call_id in place
    assert max(r.depth for r in out if r.status == "linked") > 0


def test_query_is_native(spark, sf_dir):
    plan = tl.op10_tool_call_linking(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))

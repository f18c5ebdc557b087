import pytest
from pyspark.sql import functions as F

from stepforge.functions import jsonschema, predicates, stats, values

HIT = [
    ({"pointer": "/status", "in": ["declined", "failed"]}, {"status": "declined"}, [{"status": "approved"}, {"other": "declined"}, None]),
    ({"pointer": "/ok", "equals": False}, {"ok": 0}, [{"ok": True}, {}]),
    ({"pointer": "/x", "equals": None}, {"x": None}, [{}, {"x": 0}]),
    ({"pointer": "/error_code", "exists": True}, {"error_code": None}, [{"ok": 1}]),
    ({"pointer": "/error"}, {"error": "x"}, [{"ok": 1}]),
    ({"pointer": "", "contains": "Error:"}, "Error: upstream", ["ok", 5]),
    ({"pointer": "", "matches": "^(Error|Failed)\\b"}, "Failed to connect", ["succeeded"]),
    ({"pointer": "/detail", "contains": "declined"}, {"detail": {"reason": "card declined"}}, [{"detail": {}}]),
]


@pytest.mark.parametrize(("declared", "hit", "misses"), HIT)
def test_predicates(declared, hit, misses):
    p = predicates.compiled(declared)
    assert predicates.holds(p, hit) and not any(predicates.holds(p, m) for m in misses)


def test_useless_predicates():
    assert [predicates.compiled(x) for x in (None, {"in": ["x"]}, "no", {"pointer": ""}, {"pointer": 3})] == [None] * 5
    assert not predicates.holds(predicates.compiled({"pointer": "", "matches": "("}), "anything")


@pytest.mark.parametrize(("pointer", "want"), [("/a/b/0", 1), ("/a/b/1/c", 2), ("", "all"), ("/", "all"), ("k", 3), ("/a~1b", 4), ("/m~0n", 5), ("/a/b/ 1/c", 2), ("/a/b/-1", None), ("/a/b/9", None), ("/a/x", None), ("/k/z", None)])
def test_pointer(pointer, want):
    doc = {"a": {"b": [1, {"c": 2}]}, "k": 3, "a/b": 4, "m~n": 5}
    value, found = predicates.resolve(doc, pointer)
    assert found == (want is not None) and (value == (doc if want == "all" else want))


def test_values():
    assert values.normal("  Straße \n X ") == "strasse x" and values.only_digits("1,234.56٣") == "123456٣"
    assert values.scalars({"a": [1, True, None, {"b": "x"}], "c": 2.5}) == [1, "x", 2.5]
    assert values.identifying(["abc", " abcd ", 99, -100, 1e16]) == {"abcd", "-100", "1e+16"}
    assert [values.nothing(x) for x in (None, "", [], {}, "No result", "not found", 0, False, "none found here")] == [True] * 6 + [False] * 3
    assert values.stable_args({"B": 1, "TS": 2, "a": {"ts": 3}}) == '{"B": 1, "a": {"ts": 3}}'
    assert values.loads_lenient("{'q': True}") == ({"q": True}, None) and values.loads_lenient("(1,2)")[1] == "(1,2)"


def test_quoting_like_repr(spark):
    names = ["plain", "it's", 'say "x"', "both ' and \"", "back\\slash", "tab\there"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(values.quoted(F.col("n"))).collect()
    assert [r[0] for r in got] == [repr(n) for n in names]


SCHEMAS = [
    ({"type": "integer"}, [1, 1.0], [1.5, True, "1"]),
    ({"type": ["string", "null"]}, ["x", None], [1]),
    ({"const": 1}, [1, 1.0], [True, 2]),
    ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, ["x", 4], [2]),
    ({"oneOf": [{"type": "integer"}, {"minimum": 2}]}, [1, 2.5], [3]),
    ({"not": {"type": "string"}}, [1], ["x"]),
    ({"allOf": [{"minLength": 2}, {"maxLength": 3}]}, ["ab"], ["a", "abcd"]),
    ({"if": {"type": "string"}, "then": {"pattern": "^a"}, "else": {"type": "number"}}, ["ab", 1], ["b", None]),
    ({"items": {"type": "integer"}, "uniqueItems": True, "minItems": 1}, [[1, 2]], [[], [1, 1], ["x"]]),
    ({"prefixItems": [{"type": "string"}], "items": False}, [["a"]], [[1], ["a", 2]]),
    ({"patternProperties": {"^n": {"type": "number"}}, "additionalProperties": {"type": "string"}}, [{"n1": 1, "x": "y"}], [{"n1": "a"}, {"x": 1}]),
    ({"dependentRequired": {"a": ["b"]}}, [{"a": 1, "b": 2}, {}], [{"a": 1}]),
    ({"$defs": {"p": {"minimum": 5}}, "properties": {"x": {"$ref": "#/$defs/p"}}}, [{"x": 6}], [{"x": 1}]),
    ({"multipleOf": 0.5}, [1.5, 2], [0.7]),
    ({"exclusiveMinimum": 1, "maximum": 3}, [2, 3], [1, 4]),
    ({"propertyNames": {"maxLength": 2}, "minProperties": 1}, [{"ab": 1}], [{}, {"abc": 1}]),
    ({"contains": {"const": 1}}, [[1, 2]], [[2]]),
    (True, [1], []),
    (False, [], [1]),
]


@pytest.mark.parametrize(("schema", "good", "bad"), SCHEMAS)
def test_schema(schema, good, bad):
    assert jsonschema.schema_problem(schema) is None
    assert all(jsonschema.found_errors(schema, x) == [] for x in good)
    assert all(jsonschema.found_errors(schema, x) for x in bad)


def test_schema_problems():
    for s in ({"type": "x"}, {"minLength": -1}, {"properties": []}, {"anyOf": []}, {"enum": 1}, {"items": {"type": 3}}, 5):
        assert jsonschema.schema_problem(s)


def test_wilson(spark):
    assert stats.wilson(8, 10) == pytest.approx((0.49016, 0.94332), abs=1e-5)
    assert stats.wilson(0, 0) == (0.0, 1.0) and stats.wilson(0, 10)[0] == 0 and 0.97 < stats.wilson(10, 10)[1] <= 1
    df = stats.with_rate(spark.createDataFrame([(8, 10), (0, 0), (10, 10)], "k long, n long"), "k", "n")
    for r in df.collect():
        assert (r["low"], r["high"]) == pytest.approx(stats.wilson(r["k"], r["n"]))


def test_bootstrap(spark):
    low, high = stats.bootstrap_mean([10, 12, 9, 11, 30], seed=1)
    assert low <= 14.4 <= high and (low, high) == stats.bootstrap_mean([10, 12, 9, 11, 30], seed=1)
    assert stats.bootstrap_mean([]) == (0, 0) and stats.bootstrap_mean([7]) == (7, 7)
    df = spark.createDataFrame([("a", 10.0), ("a", 12.0), ("a", 30.0), ("b", 7.0), ("c", None)], "k string, v double")
    got = {r["k"]: (r["low"], r["high"]) for r in stats.bootstrap_by(df, "k", "v", seed=3).collect()}
    assert got == {"a": stats.bootstrap_mean([10.0, 12.0, 30.0], 3), "b": (7, 7), "c": (0, 0)}


def test_draws_of_pythons_generator():
    import random

    for seed, n in ((0, 5), (3, 64), (9, 1000)):
        rng, draws = random.Random(seed), stats.Draws(seed)
        want = [rng.randrange(n) for _ in range(3000)]
        assert [*draws.below(n, 1000), *draws.below(n, 2000)] == want
    values = [random.Random(4).uniform(0, 9) for _ in range(37)]
    draw = random.Random(2).randrange
    means = sorted(sum(values[draw(37)] for _ in range(37)) / 37 for _ in range(300))
    assert stats.bootstrap_mean(values, 2, 300) == pytest.approx((means[7], means[292]))


def test_rows_of_equal_values_are_evaluated_once():
    import pyarrow as pa

    seen = []
    fn = lambda x, y: seen.append((x, y)) or {"x": x, "n": [y, y]}
    x, y = ["a", None, "b", "a", None, "a"], ["1", "1", None, "1", "1", "2"]
    got = values.evaluated(fn, (pa.array(x), pa.array(y)), pa.struct([("x", pa.string()), ("n", pa.list_(pa.string()))]))
    assert got.to_pylist() == [{"x": a, "n": [b, b]} for a, b in zip(x, y, strict=True)]
    assert sorted(seen, key=str) == sorted(set(zip(x, y, strict=True)), key=str)
    assert values.evaluated(fn, (pa.array([], pa.string()), pa.array([], pa.string())), pa.string()).to_pylist() == []


@pytest.mark.parametrize("name", ["discovered_tools", "r1_flat_schema", "predicate_text"])
def test_a_filtered_python_column_is_computed_once(spark, name):
    """F11 and F16: the filter was pushed below the column, and Python ran twice for every row."""
    from stepforge.plans import catalog

    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1

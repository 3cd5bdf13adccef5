"""Random keys beside names, in paths and of one kind of characters."""

import random
import string

from pyspark.sql import functions as F

from scholia.llm import secrets as S


def test_keys_are_found_beside_names_in_paths_and_without_digits(spark):
    rng = random.Random(7)
    base62 = string.ascii_letters + string.digits
    draw = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    rows, want = [], {}
    for i in range(600):
        before, after, alphabet = (("client_key=", "&user_id=7", base62), ("see /user_x/", "/a-b", base62), ("is ", ".", string.ascii_letters), ("is ", ".", string.digits), ("sig=", "==", base62 + "+/"), ("?x=1&sig=", "&y=2", base62))[i % 6]
        key = draw(alphabet, 40)
        rows.append((i, before + key + after))
        want[i] = (len(before), len(before) + 40)
    rows += [(i, "a " + "-".join(rng.choices("path index file release build node linux test alpha the".split(), k=7)) + " z") for i in range(600, 900)]
    got = {r["doc_id"]: r["secrets"] for r in S.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in range(6):
        held = [any(s["start"] <= want[i][0] and want[i][1] <= s["end"] for s in got[i]) for i in range(kind, 600, 6)]
        assert sum(held) >= 85, (kind, sum(held))
    assert sum(len(got[i]) > 0 for i in range(600, 900)) <= 9


def test_pieces_have_their_own_places(spark):
    key = "Zq3vT8xLr0Wm5KdYb2Hc"
    texts = [(0, f"é a={key}=b"), (1, f"/u_x/{key}"), (2, f"k={key[:19]}="), (3, "ab" + "=" * 30)]
    rows = S._scanned(spark.createDataFrame(texts, "doc_id long, text string"), F.col("text"), 20).collect()
    found = {r["doc_id"]: {(x["start"], x["end"]) for x in r["_runs"]} for r in rows}
    assert (4, 24) in found[0] and (5, 25) in found[1] and found[2] == {(2, 22)} and found[3] == set()


def test_many_matches_in_one_text(spark):
    """Spans, redaction and pieces of a text with thousands of matches; none is lost and none is moved."""
    part = "token=abcdefgh1 ünd "
    key = "Zk3vQ9xLw2Rt8YbNc5Hd "
    rows = [(1, part * 3000), (2, (part + key) * 1500), (3, "a" * 25 + " " + "-".join(["Q7fJ2kXv9LmB4nTz6RwC"] * 1000))]
    found = {r["doc_id"]: r for r in S.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), keep=("doc_id", "text")).withColumn("clean", S.redact(F.col("text"), F.col("secrets"))).collect()}
    assert [(s["start"], s["end"]) for s in found[1]["secrets"]] == [(i * len(part), i * len(part) + 15) for i in range(3000)]
    assert found[1]["clean"] == "[SECRET] ünd " * 3000
    step = len(part + key)
    assert [(s["start"], s["end"]) for s in found[2]["secrets"] if s["kind"] == "assign"] == [(i * step, i * step + 15) for i in range(1500)]
    # pieces of a long run: the run as a whole (with its joints) is longer than each, and is what is tested last
    pieces = S._scanned(spark.createDataFrame(rows[2:], "doc_id long, text string"), F.col("text"), 20).first()["_runs"]
    assert {(p["start"], p["end"]) for p in pieces} >= {(26 + 21 * i, 46 + 21 * i) for i in range(1000)}


def test_overlapping_spans_and_prefix_states(spark):
    one = spark.range(1)
    spans = [(5, 9), (0, 4), (2, 4), (0, 4), (8, 12), (5, 9), (20, 21)]
    column = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in spans])
    got = one.select(S._longest(column).alias("longest"), S._distinct(column).alias("distinct"), S._apart(column, F.array(F.struct(F.lit(3).alias("start"), F.lit(6).alias("end")))).alias("apart")).first()
    assert [tuple(s) for s in got["longest"]] == [(0, 4), (5, 9), (8, 12), (20, 21)]
    assert [tuple(s) for s in got["distinct"]] == sorted(set(spans))
    assert sorted(map(tuple, got["apart"])) == [(8, 12), (20, 21)]
    for n in (0, 1, 2, 3, 10, 101):
        items = [(i * 7) % 13 for i in range(n)]
        states = one.select(S._before(F.lit(items) if n else F.expr("cast(array() as array<int>)"), F.lit(0), lambda at, x: at + x).alias("x")).first()["x"]
        assert [s["state"] for s in states] == [sum(items[:i]) for i in range(n)]

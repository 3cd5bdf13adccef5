"""Secret scans with a randomness test battery, on DataFrame functions alone.

Known shapes (assignments, access keys, hexadecimal runs) are found by patterns. Other runs of key characters are put to a battery:
their encoding is inferred, and under "drawn uniformly from that alphabet" a chi-squared test, a runs test about the alphabet's middle and a
lag-one serial correlation test each give a p-value; Fisher's rule combines them. Random strings have uniform p-values, words and paths have
small ones. So within a stratum of encoding and length, twice the count above 1/2 estimates the random strings, and the excess over their even spread
above a threshold estimates the false discoveries: the smallest threshold that holds that share below ``fdr`` is the stratum's own. Thresholds come
from a histogram over all rows, a bounded table whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# The three known shapes, in the order in which spans of one start are listed.
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

#: Runs of these are cut into the pieces that the battery tests: the longest of each class of characters, so that a name, a path or a parameter beside a key is not in the key's piece.
RUN_CHARACTERS = "A-Za-z0-9+/_=-"
PIECES = ("A-Za-z0-9+/", "A-Za-z0-9_-", "A-Za-z0-9")
#: Characters of padding at most, those of base32.
PADDING = 6
#: The alphabets in the order in which an encoding is inferred: the first that holds all characters.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {
    "digits": (r"^[0-9]+$", _DIGITS),
    "hex": (r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    "HEX": (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    "lower": (r"^[a-z]+$", _LOWER),
    "UPPER": (r"^[A-Z]+$", _UPPER),
    "base32": (r"^[A-Z2-7]+$", _UPPER + "234567"),
    "base36": (r"^[0-9a-z]+$", _DIGITS + _LOWER),
    "BASE36": (r"^[0-9A-Z]+$", _DIGITS + _UPPER),
    "letters": (r"^[A-Za-z]+$", _UPPER + _LOWER),
    "base62": (r"^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    "base64": (r"^[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    "base64url": (r"^[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
}
#: p-values are counted in so many bins; lengths in classes that double.
BINS = 50

_NO_SPANS = "cast(array() as array<struct<start:int,end:int,found:string>>)"


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(items: Column, state: Column, following) -> Column:
    """items cut into blocks of about the root of their number, each with the state that ``following(state, item)`` has reached before it.

    Appending to an array copies it. States are appended once a block here, and what a block makes is gathered in arrays of its length, so n items cost n^1.5 copies and not n^2.
    """

    def cut_up(v: Column) -> Column:
        width = v["width"]

        def step(acc: Column, x: Column) -> Column:
            marks = F.when(acc["i"] % width == 0, F.concat(acc["marks"], F.array(acc["state"]))).otherwise(acc["marks"])
            return F.struct((acc["i"] + 1).alias("i"), following(acc["state"], x).alias("state"), marks.alias("marks"))

        start = F.struct(F.lit(0).alias("i"), state.alias("state"), F.slice(F.array(state), 1, 0).alias("marks"))
        marks = F.aggregate(v["items"], start, step, lambda acc: acc["marks"])
        return F.transform(marks, lambda m, i: F.struct(m.alias("state"), F.slice(v["items"], i * width + 1, width).alias("items")))

    return _let(items, lambda held: _let(F.struct(held.alias("items"), F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(held)))).cast("int").alias("width")), cut_up))


def _before(items: Column, state: Column, following) -> Column:
    """(item, state) for every item: the state that ``following`` has reached before it."""

    def within(block: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.struct(following(acc["state"], x).alias("state"), F.concat(acc["out"], F.array(F.struct(x.alias("item"), acc["state"].alias("state")))).alias("out"))

        none = F.slice(F.transform(block["items"], lambda x: F.struct(x.alias("item"), block["state"].alias("state"))), 1, 0)
        return F.aggregate(block["items"], F.struct(block["state"].alias("state"), none.alias("out")), step, lambda acc: acc["out"])

    return F.flatten(F.transform(_blocks(items, state, following), within))


def _located(text: Column, pattern: str, needs: Column, group: int | None = None, least: int = 0, found: bool = False) -> Column:
    """All leftmost non-overlapping matches as (start, end, found), in code points; those whose group is shorter than ``least`` dropped. found is null unless asked for.

    Matches and the gaps between them alternate, so running lengths give the places.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else None

    def measured(m: Column) -> Column:
        gaps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), m, lambda g, x: F.struct(F.length(g).alias("gap"), F.length(x).alias("size"), (x if found else F.lit(None).cast("string")).alias("found")))
        return F.zip_with(gaps, values if group else m, lambda x, v: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), x["found"].alias("found"), (F.length(v) >= least).alias("long")))

    placed = F.filter(_before(_let(matches, measured), F.lit(0), lambda at, x: at + x["gap"] + x["size"]), lambda p: p["item"]["long"])
    spans = F.transform(placed, lambda p: F.struct((p["state"] + p["item"]["gap"]).alias("start"), (p["state"] + p["item"]["gap"] + p["item"]["size"]).alias("end"), p["item"]["found"].alias("found")))
    return F.when(needs, spans).otherwise(F.expr(_NO_SPANS))


def _distinct(spans: Column) -> Column:
    """Distinct spans by start and end."""
    ordered = F.array_sort(spans)
    last = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    kept = F.filter(_before(ordered, last, lambda _, x: F.struct(x["start"].alias("start"), x["end"].alias("end"))), lambda p: (p["state"]["start"] != p["item"]["start"]) | (p["state"]["end"] != p["item"]["end"]))
    return F.transform(kept, lambda p: p["item"])


def _longest(spans: Column) -> Column:
    """Distinct spans that no other one holds, by start."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    return F.transform(F.filter(_before(ordered, F.lit(-1), lambda far, x: F.greatest(far, x["end"])), lambda p: p["state"] < p["item"]["end"]), lambda p: p["item"])


def _apart(spans: Column, base: Column) -> Column:
    """Spans that touch none of the base spans: no base span before them reaches into them, and none after starts in them."""
    far = 1 << 30
    marked = F.concat(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("fixed"), s.alias("span"))), F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("fixed"), s.alias("span"))))
    ahead = _before(F.array_sort(marked, lambda a, b: a["start"] - b["start"]), F.lit(-1), lambda end, x: F.greatest(end, F.when(x["fixed"] == 1, x["span"]["end"]).otherwise(-1)))
    back = _before(F.reverse(ahead), F.lit(far), lambda low, x: F.least(low, F.when(x["item"]["fixed"] == 1, x["item"]["start"]).otherwise(far)))
    clear = F.filter(back, lambda p: (p["item"]["item"]["fixed"] == 0) & (p["item"]["state"] <= p["item"]["item"]["start"]) & (p["state"] >= p["item"]["item"]["span"]["end"]))
    return F.when((F.size(base) > 0) & (F.size(spans) > 0), F.reverse(F.transform(clear, lambda p: p["item"]["item"]["span"]))).otherwise(spans)


def _normal_tail(z: Column) -> Column:
    """P(N > z) for z >= 0 by the rational approximation of Abramowitz and Stegun 26.2.17 (error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * 0.3989422804014327 * poly


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-12), 2 * _normal_tail(F.abs(z))))


def _upper(z: Column) -> Column:
    return F.greatest(F.lit(1e-12), F.when(z >= 0, _normal_tail(F.abs(z))).otherwise(1 - _normal_tail(F.abs(z))))


def _sum(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + of(x))


def _battery(token: Column, alphabet: Column) -> Column:
    """Combined p-value of the battery for a token over an alphabet, under "its characters are drawn uniformly"."""

    def counted(v: Column) -> Column:
        index, n, middle = v["index"], F.size(v["index"]).cast("double"), F.length(v["alphabet"]) / 2
        pairs = F.zip_with(F.slice(index, F.lit(1), F.size(index) - 1), F.slice(index, F.lit(2), F.size(index) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.struct(
            index.alias("index"), pairs.alias("pairs"), n.alias("n"), F.length(v["alphabet"]).cast("double").alias("size"),
            _sum(F.array_distinct(index), lambda i: F.pow(F.size(F.filter(index, lambda x: x == i)).cast("double"), F.lit(2.0))).alias("squares"),
            _sum(index, lambda x: F.when(x >= middle, 1.0).otherwise(0.0)).alias("high"),
            _sum(pairs, lambda ab: F.when((ab["a"] >= middle) != (ab["b"] >= middle), 1.0).otherwise(0.0)).alias("changes"),
            (_sum(index, lambda x: x) / n).alias("mean"),
        )

    def scored(v: Column) -> Column:
        n, size, both, mean = v["n"], v["size"], 2 * v["high"] * (v["n"] - v["high"]), v["mean"]
        return F.struct(
            n.alias("n"),
            ((v["squares"] * size / n - n - (size - 1)) / F.sqrt(2.0 * (size - 1) * (n - 1) / n)).alias("chi"),
            (v["changes"] - both / n).alias("excess"), (both * (both - n) / (n * n * (n - 1))).alias("variance"),
            _sum(v["index"], lambda x: (x - mean) * (x - mean)).alias("spread"),
            _sum(v["pairs"], lambda ab: (ab["a"] - mean) * (ab["b"] - mean)).alias("lagged"),
        )

    def combined(v: Column) -> Column:
        n = v["n"]
        # all characters in one half, or all alike: as far from random as the length allows
        p_runs = F.when(v["variance"] > 0, _two_sided(v["excess"] / F.sqrt(v["variance"]))).otherwise(F.greatest(F.lit(1e-12), F.pow(F.lit(2.0), 1 - n)))
        p_serial = F.when(v["spread"] > 0, _two_sided((v["lagged"] / v["spread"] + 1 / n) * F.sqrt(n))).otherwise(F.lit(1e-12))
        evidence = -F.log(_upper(v["chi"])) - F.log(p_runs) - F.log(p_serial)
        return _let(evidence, lambda e: F.least(F.lit(1.0), F.exp(-e) * (1 + e + e * e / 2)))

    index = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c).cast("double") - 1)
    return _let(_let(_let(F.struct(index.alias("index"), alphabet.alias("alphabet")), counted), scored), combined)


def _tested(candidates: Column) -> Column:
    """(start, end, stratum, bin) of every candidate whose encoding can be inferred."""

    def inferred(c: Column) -> Column:
        token = F.regexp_replace(c["found"], "=+$", "")
        spec = F.lit(None).cast("struct<name:string,alphabet:string>")
        for name, (pattern, alphabet) in reversed(ALPHABETS.items()):
            spec = F.when(token.rlike(pattern), F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("alphabet"))).otherwise(spec)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), token.alias("token"), spec.alias("spec"))

    def tested(c: Column) -> Column:
        length_class = F.floor(F.log2(F.length(c["token"]).cast("double") / 10)).cast("string")
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), F.concat(c["spec"]["name"], F.lit(":"), length_class).alias("stratum"),
            F.least(F.lit(BINS - 1), F.floor(_battery(c["token"], c["spec"]["alphabet"]) * BINS).cast("int")).alias("bin"),
        )

    return F.transform(F.filter(F.transform(candidates, inferred), lambda c: c["spec"].isNotNull()), tested)


def _scanned(documents: DataFrame, text: Column, least_run: int) -> DataFrame:
    """All rows with base spans (assign, access, hex) and tested pieces of runs that no base span touches."""
    assigns = text.rlike("[:=]") & text.rlike(ASSIGN)
    out = documents.withColumns({"_assign": _located(text, ASSIGN, assigns, 2, 8), "_access": _located(text, ACCESS, text.contains("AKIA")), "_hex": _located(text, HEX, text.rlike(HEX))})
    # runs are found once; pieces are cut out of them alone. '=' is in a piece only as padding at the end of its run
    run = f"(?<![{RUN_CHARACTERS}])[{RUN_CHARACTERS}]{{{least_run},}}+"  # whole runs alone: inside a word no match is begun
    pieces = [f"[{kind}]+(?:={{1,{PADDING}}}$)?" for kind in PIECES]

    def cut_out(r: Column) -> Column:
        shifted = [F.transform(_located(r["found"], piece, F.lit(True), least=least_run, found=True), lambda p: F.struct((p["start"] + r["start"]).alias("start"), (p["end"] + r["start"]).alias("end"), p["found"].alias("found"))) for piece in pieces]
        whole = F.array(F.struct(r["start"].alias("start"), r["end"].alias("end"), r["found"].alias("found")))
        return F.when(r["found"].rlike("^[A-Za-z0-9]+$"), whole).otherwise(_distinct(F.concat(*shifted)))

    located = F.flatten(F.transform(_located(text, run, text.rlike(run), found=True), cut_out))
    base = F.concat("_assign", "_access", "_hex")
    out = out.withColumn("_runs", F.filter(located, lambda c: F.length(F.rtrim(c["found"], F.lit("="))) >= 2)).withColumn("_runs", _apart(F.col("_runs"), base))
    return out.withColumn("_runs", F.when(F.size("_runs") > 0, _tested(F.col("_runs"))).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,stratum:string,bin:int>>)")))


def random_run_thresholds(scanned: DataFrame, fdr: float) -> dict[str, int]:
    """Lowest accepted bin of every stratum (encoding and length class). Its size is bounded by alphabets and doubling lengths."""
    counts = scanned.select(F.explode("_runs").alias("r")).groupBy(F.col("r.stratum").alias("stratum"), F.col("r.bin").alias("bin")).count()
    grid = counts.select("stratum").distinct().select("stratum", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin")).join(counts, ["stratum", "bin"], "left").na.fill(0, ["count"])
    upward = Window.partitionBy("stratum").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("stratum")
    tails = grid.withColumn("above", F.sum("count").over(upward)).withColumn("upper_half", F.sum(F.when(F.col("bin") >= BINS // 2, F.col("count")).otherwise(0)).over(whole))
    expected = 2 * F.col("upper_half") * (1 - F.col("bin") / BINS)
    held = tails.where((F.col("above") > 0) & (F.col("above") - expected <= fdr * F.col("above")))
    return {r["stratum"]: r["low"] for r in held.groupBy("stratum").agg(F.min("bin").alias("low")).collect()}


def scan_secrets(documents: DataFrame, fdr: float = 0.1, least_run: int = 20, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Secrets in every whole text of ``documents``: the columns named in ``keep`` and secrets array<struct<start, end, kind>>.

    Spans are in code points, end exclusive, ordered by start and then kind (assign, access, hex, random). Assignments need a value of 8
    characters, access keys 16 characters and hexadecimal runs 32; random runs need ``least_run`` characters (padding counts), no overlap with
    a known shape, and a battery p-value above their stratum's threshold; of accepted pieces of which one holds the other, the longer is the span. Null and empty texts have no spans. Rows are never dropped or merged:
    repeated rows get equal results, and extra columns pass through only if kept; an empty table gives no rows. The scan runs once: what it finds is written beside the kept columns, and the
    thresholds are taken from there. Texts of any number of matches cost little more than their length (see ``_blocks``).
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    held = [f"_kept{i}" for i in range(len(keep))]  # kept columns can have any names
    scanned = _scanned(documents.select(*[F.col(c).alias(h) for c, h in zip(keep, held)], F.col("text").alias("_text")), text, least_run)
    scanned = stored(scanned.select(*held, *[F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(c) for c in ("_assign", "_access", "_hex")], "_runs"))
    thresholds = random_run_thresholds(scanned, fdr)
    if thresholds:
        lowest = F.create_map(*[x for k, v in sorted(thresholds.items()) for x in (F.lit(k), F.lit(v))])
        accepted = F.filter("_runs", lambda r: F.coalesce(r["bin"] >= F.element_at(lowest, r["stratum"]), F.lit(False)))
        accepted = F.when(F.size(accepted) > 1, _longest(accepted)).otherwise(accepted)
    else:
        accepted = F.slice("_runs", 1, 0)

    def ranked(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("rank"), s["end"].alias("end")))

    parts = [ranked(spans, kind) for kind, spans in enumerate((F.col("_assign"), F.col("_access"), F.col("_hex"), accepted))]
    names = F.array(*map(F.lit, KINDS))
    return scanned.select(*[F.col(h).alias(c) for c, h in zip(keep, held)], F.transform(F.array_sort(F.concat(*parts)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(names, s["rank"] + 1).alias("kind"))).alias("secrets"))


def redact(text: Column, secrets: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mark``; spans that overlap are replaced as one. Null stays null.

    The text is cut block by block, then span by span, since finding a place in a text takes its length.
    """
    spans = _blocks(secrets, F.lit(0), lambda at, s: F.greatest(at, s["end"]))

    def replaced(block: Column) -> Column:
        def cut_out(b: Column) -> Column:
            def piece(p: Column) -> Column:
                gap = F.substring(b["text"], p["state"] - b["at"] + 1, p["item"]["start"] - p["state"])
                return F.when(p["item"]["start"] >= p["state"], F.concat(gap, F.lit(mark))).otherwise("")

            return F.array_join(F.transform(_before(b["items"], b["at"], lambda at, s: F.greatest(at, s["end"])), piece), "")

        end = F.greatest(block["state"], F.array_max(F.transform(block["items"], lambda s: s["end"])))
        return _let(F.struct(block["state"].alias("at"), block["items"].alias("items"), F.substring(text, block["state"] + 1, end - block["state"]).alias("text")), cut_out)

    last = F.array_max(F.transform(secrets, lambda s: s["end"]))
    rebuilt = F.concat(F.array_join(F.transform(spans, replaced), ""), F.substring(text, last + 1, F.length(text)))
    return F.when(F.size(secrets) > 0, rebuilt).otherwise(text)

"""Personal data (operator 8), DataFrame functions only.

Regular expressions propose spans; validators confirm them (number ranges,
digit counts, Luhn, mod-97); words near a span move its score. One scan: each
row's matches and the gaps between them (``split`` by the same expression) are
exploded as short rows, texts are not shuffled; offsets are running sums of
gap and match lengths per row and kind, in code points.

Base kinds (email, ip, card, phone) follow fixed definitions: leftmost,
non-overlapping matches, those that fail validation are dropped. The method
adds spans of the same kinds that a longer failed match had swallowed
(``strict`` forms), and the kinds iban (mod-97) and ssn. An added span must reach
``min_score``, and must not overlap a base span of its kind.

The expressions are linear in the text: repeated parts are possessive (nothing
after them could match by giving back) and a match can't start inside a run
that has failed, unless the previous match ended there (\\G). They match what
the plain forms match.

Defined results: a null or empty text has no spans; every input row gives one
output row, repeated rows repeated ones; an empty table gives an empty result.
Only the id and text are read, other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "ssn")
KINDS = BASE + EXTRA

#: The base definitions; see the module docstring for their written form.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What the method adds: (kind, expression).
STRICT = (
    ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[\x20-]?\([0-9]{2,4}\)[\x20-]?[0-9]{3}[\x20-]?[0-9]{4}(?![0-9])"),
    ("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,4})?)(?![A-Za-z0-9])"),
    ("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"),
)
#: Score of a proposed span, of a passed validation, and of a context word near it.
SCORE = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.4, "ssn": 0.4}
CHECKSUM = {"card": 0.4, "iban": 0.5, "phone": 0.2, "ip": 0.2}
NEAR = 0.3
CONTEXT = {
    "email": r"(?i)mail|contact|write to|kontakt|correo|courriel",
    "ip": r"(?i)\bip\b|address|host|server|login",
    "card": r"(?i)card|visa|credit|payment|karte|tarjeta|carte",
    "phone": r"(?i)phone|\btel|call|mobile|fax|anruf|tel[eé]fono",
    "iban": r"(?i)iban|account|bank|konto|cuenta|compte",
    "ssn": r"(?i)ssn|social security|tax id",
}
AGAINST = {"ip": r"(?i)version|release|v\.?\x20?$", "card": r"(?i)isbn|serial|order no", "ssn": r"(?i)part no|serial"}
CONTEXT_CHARS = 40


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: acc + F.coalesce(
        F.when((n - i) % 2 == 0, F.substring(number, i, F.lit(1)).try_cast("int")).otherwise(
            (F.substring(number, i, F.lit(1)).try_cast("int") * 2) % 10
            + F.floor(F.substring(number, i, F.lit(1)).try_cast("int") / 5).cast("int")), F.lit(0)))
    return (n > 0) & (total % 10 == 0)


def mod97(iban: Column) -> Column:
    """Whether an IBAN (spaces allowed) leaves 1 modulo 97."""
    s = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, F.lit(1), F.lit(4)))
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).when(
        c.rlike("[0-9]"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))
    return F.length(s).between(15, 34) & (rest == 1)


def valid(kind: Column, s: Column) -> Column:
    d = digits(s)
    parts = F.split(s, r"\.")
    in_range = F.forall(parts, lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3) & F.forall(
        parts, lambda p: F.substring(F.regexp_replace(p, "^0+(?=[0-9])", ""), 1, 4).try_cast("int") <= 255)
    return (F.when(kind == "ip", in_range).when(kind == "card", F.length(d).between(13, 19) & luhn(d))
            .when(kind == "phone", F.length(d).between(9, 15)).when(kind == "iban", mod97(s)).otherwise(F.lit(True)))


def proposals(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, p): one row per proposed span, p null where a text has none."""
    forms = [(k, PATTERNS[k], True) for k in BASE] + [(k, p, False) for k, p in STRICT]
    need = {"email": "@", "phone": "+", "ip": ".", "ssn": "-"}
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.withColumn("dig", F.col("t").rlike("[0-9]"))
    none = F.array().cast("array<string>")

    def may(kind: str) -> Column:
        has = F.contains("t", F.lit(need[kind])) if kind in need else F.lit(True)
        return has if kind == "email" else F.col("dig") & has

    d = d.withColumns({f"m{i}": F.when(may(k), F.regexp_extract_all("t", F.lit(p), F.lit(0))).otherwise(none)
                       for i, (k, p, _) in enumerate(forms)})
    # The gaps only where there is a match: gap i precedes match i.
    d = d.withColumns({f"g{i}": F.when(F.size(f"m{i}") > 0, F.split("t", p, -1)).otherwise(none)
                       for i, (_, p, _) in enumerate(forms)})
    def proposed(i: int, kind: str, base: bool) -> Column:
        gap = lambda j: F.coalesce(F.get(f"g{i}", j), F.lit(""))
        return F.transform(f"m{i}", lambda m, j: F.struct(
            F.lit(kind).alias("kind"), F.lit(i).alias("form"), F.lit(base).alias("base"), j.alias("j"), m.alias("s"),
            F.length(gap(j)).alias("gap"), F.right(gap(j), F.lit(CONTEXT_CHARS)).alias("before"),
            F.left(gap(j + 1), F.lit(CONTEXT_CHARS)).alias("after")))

    found = F.concat(*(proposed(i, k, base) for i, (k, _, base) in enumerate(forms)))
    return d.select("row", "id", F.explode_outer(found).alias("p"))


def by_kind(kind: Column, values: dict, otherwise=None) -> Column:
    out = F.lit(otherwise)
    for k, v in values.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.7) -> DataFrame:
    """(id, spans array<struct<kind, start, end, base, score>>) for each row:
    the base spans and the added ones, by kind as in ``KINDS``, then start."""
    # All that follows groups by row: one shuffle of short rows.
    p = proposals(docs, id_col, text_col).select("row", "id", "p.*").repartition("row")
    w = Window.partitionBy("row", "form").orderBy("j")
    p = p.withColumn("end", F.sum(F.col("gap") + F.length("s")).over(w)).withColumn("start", F.col("end") - F.length("s"))
    near = F.concat_ws(" ", "before", "after")
    score = (by_kind(F.col("kind"), SCORE, 0.0) + by_kind(F.col("kind"), CHECKSUM, 0.0)
             + by_kind(F.col("kind"), {k: F.when(near.rlike(c), NEAR).otherwise(0.0) for k, c in CONTEXT.items()}, 0.0)
             - by_kind(F.col("kind"), {k: F.when(F.col("before").rlike(c), NEAR).otherwise(0.0) for k, c in AGAINST.items()}, 0.0))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    keep = F.col("s").isNotNull() & valid(F.col("kind"), F.col("s"))
    p = p.withColumns({"score": F.round(F.least(score, F.lit(1.0)), 3), "rank": rank, "keep": keep})
    p = p.withColumn("keep", F.col("keep") & (F.col("base") | (F.col("score") >= min_score)))
    # Base spans of a kind don't overlap, so an added span overlaps one iff the
    # last that starts before it ends inside it or the next starts inside it.
    # Of added spans that overlap each other the first stays.
    in_order = Window.partitionBy("row", "kind").orderBy("start", F.desc("base"), "form")
    up_to, after = in_order.rowsBetween(Window.unboundedPreceding, -1), in_order.rowsBetween(1, Window.unboundedFollowing)
    base, added = F.col("keep") & F.col("base"), F.col("keep") & ~F.col("base")
    p = p.withColumns({
        "base_end": F.max(F.when(base, F.col("end"))).over(up_to), "base_start": F.min(F.when(base, F.col("start"))).over(after),
        "added_end": F.max(F.when(added, F.col("end"))).over(up_to)})
    free = ((F.coalesce("base_end", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("base_start"), F.col("end")) >= F.col("end"))
            & (F.coalesce("added_end", F.lit(0)) <= F.col("start")))
    span = F.struct("rank", "start", "end", "kind", "base", "score")
    # collect_list skips nulls: rows without a span keep an empty list.
    return p.groupBy("row", "id").agg(
        F.sort_array(F.collect_list(F.when(F.col("keep") & (F.col("base") | free), span))).alias("all")).select(
        F.col("id").alias(id_col), F.transform("all", lambda x: F.struct(
            x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"),
            x["score"].alias("score"))).alias("spans"))


def written(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda x: x["base"])
    n_of = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long")
    return s.select(
        "doc_id", *(n_of(k).alias(f"n_{k}") for k in BASE),
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))

r"""Personal data by patterns and by bootstrapped contexts, in DataFrame functions only.

Base spans of four kinds come from regular expressions and checks. Then contexts are
learned. A *run* is one or more neighbouring words with a digit or an at sign; its *core*
leaves out a label before it (``ip=``) and punctuation around it. The context patterns of a
run are the two words before it, the words on both sides, and the label. Cores that are base
spans are the seeds. In rounds, over the graph of patterns and cores:

* a pattern's confidence for a kind is the confidence of its known cores over all its
  distinct cores (plus one); it is trusted from ``SUPPORT`` known cores and ``TRUSTED`` on;
* a core's confidence is the noisy-or of its trusted patterns; from ``ACCEPTED`` on, and if
  it has the kind's bare shape, it is known in the next round.

Every occurrence of a core learned this way is an added span, unless it overlaps a base span.
Sums are per distinct pattern and core, so a very common context is pre-aggregated.

The regular expressions are those of the contract, rewritten without backtracking: groups
that cannot give anything back are possessive, and a match is only tried where one can start.
Spans are in code points, the end exclusive.

Defined results: a null text is empty; rows equal in key and text share one result; rows
without a key are left out; context words are at most ``CONTEXT`` characters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.tables import own_column, saved, whole_row

KINDS = ("email", "ip", "card", "phone")
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = (
    rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
WORD = r"[^\x20\x09-\x0D]"
CODE_WORD = r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
RUN = rf"(?<!{WORD}){CODE_WORD}(?:\x20{CODE_WORD})*+"
RUN_KIND = len(KINDS)
LABEL = r"""^(?:[A-Za-z_]{1,30}[=:]["']?|["'<\[])"""
TAIL = r"""[.,;:!?"'>\]]{1,8}$"""
CONTEXT = 60

ROUNDS, SUPPORT, TRUSTED, ACCEPTED = 3, 3, 0.6, 0.6
SHAPES = (
    r"^[^@\x20]+@[^@\x20]+$",
    r"^[0-9]+(?:[.:][0-9]+){3,}$",
    r"^[0-9](?:[\x20.-]?[0-9]){11,}$",
    r"^[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}$",
)


@dataclass
class Found:
    """``base`` and ``added``: ``key, hash`` of a row and ``spans`` (``kind, start, end``)."""

    base: DataFrame
    added: DataFrame


def _checked(kind: Column, match: Column) -> Column:
    """Whether a match of a base pattern stands."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    ip = match.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)(?:\.|$)){4}$")
    card = F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    phone = F.length(digits).between(8, 15)
    return F.when(kind == 0, True).when(kind == 1, ip).when(kind == 2, card).when(kind == 3, phone).otherwise(True)


def _matches(rows: DataFrame) -> DataFrame:
    """Every match of every pattern with its place and the words around it."""
    some = rows.where(F.col("text").rlike("[0-9@]")).withColumn("_copy", F.monotonically_increasing_id())
    needs = ("@", ".", None, "+", None)

    def pieces(kind: int, pattern: str) -> Column:
        gaps = F.split("text", pattern, -1)
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        zipped = F.struct(F.lit(kind).alias("kind"), gaps.alias("gaps"), found.alias("found"))
        return F.when(F.contains("text", F.lit(needs[kind])), zipped) if needs[kind] else zipped

    all_kinds = F.array(*[pieces(k, p) for k, p in enumerate((*PATTERNS, RUN))])
    per_kind = some.select("key", "hash", "_copy", F.explode(all_kinds).alias("m")).where(F.size("m.found") > 0)
    zipped = F.arrays_zip(F.col("m.gaps").alias("gap"), F.col("m.found").alias("found"))
    each = per_kind.select("key", "hash", "_copy", F.col("m.kind").alias("kind"), F.posexplode(zipped).alias("pos", "z"))
    gap, found = F.col("z.gap"), F.col("z.found")
    before = F.slice(F.reverse(F.split(F.rtrim(F.regexp_replace(F.right(gap, F.lit(2 * CONTEXT)), r"[\x09-\x0D]", " ")), r"\x20+")), 1, 2)
    after = F.split(F.ltrim(F.regexp_replace(F.left(gap, F.lit(CONTEXT)), r"[\x09-\x0D]", " ")), r"\x20+")[0]
    is_run = F.col("kind") == RUN_KIND
    placed = each.select(
        "key",
        "hash",
        "_copy",
        "kind",
        "pos",
        found.alias("match"),
        F.length(gap).alias("_gap"),
        F.when(is_run, before).alias("before"),
        F.when(is_run, after).alias("_after"),
    )
    order = Window.partitionBy("_copy", "kind").orderBy("pos")
    earlier = F.sum(F.col("_gap") + F.coalesce(F.length("match"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return placed.select(
        "key",
        "hash",
        "kind",
        "match",
        "before",
        F.lead("_after").over(order).alias("after"),
        (F.coalesce(earlier, F.lit(0)) + F.col("_gap")).alias("start"),
    ).where(F.col("match").isNotNull() & _checked(F.col("kind"), F.col("match")))


def _normal(word: Column) -> Column:
    return F.left(F.regexp_replace(F.lower(F.coalesce(word, F.lit(""))), "[0-9]", "0"), F.lit(CONTEXT))


def _runs(matches: DataFrame) -> DataFrame:
    """Runs with their core and context patterns."""
    label = F.regexp_extract("match", LABEL, 0)
    rest = F.expr("substring(match, length(_label) + 1)")
    near, far = _normal(F.get("before", F.lit(0))), _normal(F.get("before", F.lit(1)))
    patterns = F.array_compact(
        F.array(
            F.when(far != "", F.concat(F.lit("2 "), far, F.lit(" "), near)),
            F.when((near != "") & (_normal(F.col("after")) != ""), F.concat(F.lit("1 "), near, F.lit(" _ "), _normal(F.col("after")))),
            F.when(F.length("_label") > 1, F.concat(F.lit("0 "), F.lower("_label"))),
        )
    )
    cores = matches.where(F.col("kind") == RUN_KIND).withColumn("_label", label).withColumn("core", F.regexp_replace(rest, TAIL, ""))
    begin = F.col("start") + F.length("_label")
    return cores.select(
        "key", "hash", begin.alias("start"), (begin + F.length("core")).alias("end"), "core", patterns.alias("patterns")
    ).where(F.length("core") > 0)


def _learned(runs: DataFrame, base: DataFrame) -> DataFrame:
    """``core, kind`` of the cores that trusted patterns bring in."""
    seeds = saved(
        runs.join(base, ["key", "hash", "start", "end"]).select("core", "kind").distinct().withColumn("conf", F.lit(1.0))
    )
    edges = saved(runs.select("core", F.explode("patterns").alias("pattern")).distinct())
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("cores"))
    shape = F.lit(False)
    for kind, pattern in enumerate(SHAPES):
        shape = F.when(F.col("kind") == kind, F.col("core").rlike(pattern)).otherwise(shape)
    known = seeds
    for _ in range(ROUNDS):
        support = edges.join(known, "core").groupBy("pattern", "kind").agg(F.sum("conf").alias("mass"), F.count("*").alias("n"))
        scored = support.where(F.col("n") >= SUPPORT).join(sizes, "pattern").withColumn("trust", F.col("mass") / (F.col("cores") + 1))
        trusted = saved(scored.where(F.col("trust") >= TRUSTED).select("pattern", "kind", "trust"))
        doubt = F.sum(F.log(1 - F.col("trust")))
        cores = edges.join(trusted, "pattern").groupBy("core", "kind").agg((1 - F.exp(doubt)).alias("conf"))
        fresh = cores.where((F.col("conf") >= ACCEPTED) & shape).join(seeds.select("core").distinct(), "core", "left_anti")
        fresh = saved(fresh)
        known = seeds.unionByName(fresh)
    best = F.row_number().over(Window.partitionBy("core").orderBy(F.desc("conf"), "kind"))
    return fresh.withColumn("_n", best).where(F.col("_n") == 1).select("core", "kind")


def find(df: DataFrame, key: str, text: str) -> Found:
    """Base and added spans of the rows that have any, per ``key`` and ``hash`` of the text."""
    matches = saved(_matches(keyed(df, key, text)))
    end = F.col("start") + F.length("match")
    base = matches.where(F.col("kind") < RUN_KIND).select("key", "hash", "kind", "start", end.alias("end")).distinct()
    runs = saved(_runs(matches))
    base = saved(base)
    span = F.struct("kind", "start", "end")
    base_spans = saved(base.groupBy("key", "hash").agg(F.array_sort(F.collect_list(span)).alias("spans")))
    new = runs.join(_learned(runs, base), "core").select("key", "hash", span.alias("span")).distinct()
    new = new.groupBy("key", "hash").agg(F.collect_list("span").alias("_new"))
    met = new.join(base_spans, ["key", "hash"], "left")
    clear = F.filter(
        "_new",
        lambda s: ~F.exists(F.coalesce("spans", F.array().cast(dict(base_spans.dtypes)["spans"])), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    added = met.select("key", "hash", F.array_sort(clear).alias("added")).where(F.size("added") > 0)
    return Found(base_spans, saved(added))


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.where(F.col("key").isNotNull()).select("key", "text", F.xxhash64("text").alias("hash"))


def as_text(spans: Column) -> Column:
    """``kind:start:end`` in order, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: ``key``, the number of base spans of each kind, ``n_added``, the SHA-256
    of the base spans' text, and all ``spans`` as text."""
    found = find(df, key, text)
    rows = keyed(df, key, text).select("key", "hash")
    joined = rows.join(found.base, ["key", "hash"], "left").join(found.added, ["key", "hash"], "left")
    none = F.array().cast(dict(found.base.dtypes)["spans"])
    joined = joined.select("key", F.coalesce("spans", none).alias("base"), F.coalesce("added", none).alias("added"))

    def count(kind: int, name: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{name}")

    counts = [count(kind, name) for kind, name in enumerate(KINDS)]
    return joined.select(
        "key",
        *counts,
        F.size("added").cast("long").alias("n_added"),
        F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
        as_text(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def masked(df: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``df`` with every span of ``text`` replaced by ``<KIND>``; spans that
    overlap are one, named after the first."""
    found = find(df, key, text)
    both = found.base.select("key", "hash", "spans").unionByName(found.added.select("key", "hash", F.col("added").alias("spans")))
    spans = both.groupBy("key", "hash").agg(
        F.array_sort(F.transform(F.flatten(F.collect_list("spans")), lambda s: F.struct(s["start"], s["end"], s["kind"]))).alias("_found")
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>")
    merged = F.aggregate(
        F.col("_found"),
        none,
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] < F.element_at(acc, -1)["end"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"), F.element_at(acc, -1)["kind"].alias("kind"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))),
    )
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    given = F.col(f"row.`{text}`")
    until = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("merged", i - 1)["end"]).cast("int")
    parts = F.transform(
        "merged", lambda s, i: F.concat(F.substring(given, until(i) + 1, s["start"].cast("int") - until(i)), F.get(names, s["kind"]))
    )
    rest = F.substring(given, F.element_at("merged", -1)["end"].cast("int") + 1, F.length(given))
    changed = F.when(F.col("_found").isNotNull(), F.concat(F.array_join(parts, ""), rest)).otherwise(given).alias(text)
    rows = df.select(whole_row(df), F.col(key).cast("long").alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"))
    joined = rows.join(spans, ["key", "hash"], "left").withColumn("merged", merged)
    return joined.select(*[changed if c == text else own_column(c) for c in df.columns])

"""Secret scan with corpus-wide ownership frequency.

Three base kinds (assignment, access key, hex string) are found by pattern.  Further candidates
(prefixed tokens and long mixed-case strings) are found as well, but a pattern cannot tell a live
credential from an example that everyone copies.  So the hash of every candidate value is counted
over the whole corpus: in how many repositories and by how many owners it stands.  A value held by
few owners looks live, in however many of their repositories it stands; one held by many owners is a
copied example.  Base spans are always reported, the
further ones only where they look live; ``redacted`` masks all reported spans.

Positions are code points.  ``split`` gives the text between matches and ``regexp_extract_all`` the
matches, both leftmost and non-overlapping, so their running lengths are the positions.

Defined results: null or empty texts have no spans; null owner or repository counts as one value of
its own; repeated rows are reported each and count once; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuloom.llm.common import stored


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    group: int  # the value
    least: int  # characters of the value
    gate: str | None  # quick test that every text with a match passes


# Fixed patterns of the base kinds, in the order in which spans at one start are listed.
BASE = (
    Kind(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6, None,
    ),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, None),
)
# Candidates of the method, reported where their owners are few.
FURTHER = (
    Kind("prefixed", r"\b(?:gh[pousr]_|xox[abprs]-|sk_live_|glpat-)[A-Za-z0-9_-]{16,}", 0, 20, None),
    Kind("opaque", r"[A-Za-z0-9+/_-]{32,}={0,2}", 0, 32, None),
)
KINDS = BASE + FURTHER
NAMES = [k.name for k in KINDS]
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def _found(text: Column, kind: Kind, order: int) -> Column:
    """Array of (start, kind, end, value) of one kind."""
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    parts = F.arrays_zip(F.split(text, kind.pattern).alias("gap"), whole.alias("hit"), value.alias("value"))
    typed = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"
    spans = F.aggregate(
        parts,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(typed).alias("out")),
        lambda a, p: F.struct(
            (a["at"] + F.coalesce(F.length(p["gap"]), F.lit(0)) + F.coalesce(F.length(p["hit"]), F.lit(0))).cast("bigint").alias("at"),
            F.when(
                F.length(p["value"]) >= kind.least,
                F.concat(
                    a["out"],
                    F.array(
                        F.struct(
                            (a["at"] + F.length(p["gap"])).cast("bigint").alias("start"),
                            F.lit(order).alias("kind"),
                            (a["at"] + F.length(p["gap"]) + F.length(p["hit"])).cast("bigint").alias("end"),
                            p["value"].alias("value"),
                        )
                    ),
                ),
            ).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    return spans


def _gate(kind: Kind, text: Column) -> Column:
    if kind.gate:
        return F.contains(text, F.lit(kind.gate))
    if kind.name == "assign":
        low = F.lower(text)
        gate = F.lit(False)
        for w in WORDS:
            gate = gate | F.contains(low, F.lit(w))
        return gate
    return text.rlike(kind.pattern)


def may_hold(text: Column) -> Column:
    """Whether any kind's quick test passes; texts without it have no spans."""
    gates = [_gate(k, text) for k in KINDS]
    out = gates[0]
    for g in gates[1:]:
        out = out | g
    return out


def candidates(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row per document: row, doc_id, owner, repository and all candidate spans of its whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), t.alias("t"),
    )
    found = [F.when(_gate(k, F.col("t")), _found(F.col("t"), k, i)).otherwise(none) for i, k in enumerate(KINDS)]
    return rows.select("row", "doc_id", "owner", "repository", F.concat(*found).alias("spans"))


def _mixed(value: Column) -> Column:
    """Whether a string has upper and lower case and digits, as random keys do."""
    return value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]")


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, repositories, owners) of every candidate value: distinct counts in three small steps.

    Every step is combined before it is shuffled, so a value copied into a third of all
    documents costs one row per task.
    """
    return (
        spans.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
        .groupBy("hash", "owner").agg(F.count("*").alias("n"))
        .groupBy("hash").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))
    )


def secret_scan(
    docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id",
    max_owners: int = 2,
) -> DataFrame:
    """One row per document: doc_id, ``base`` and ``spans`` (arrays of (start, kind, end)), n_live, n_copied.

    A value looks live while at most ``max_owners`` owners hold it.
    """
    found = stored(candidates(docs, text, owner, repository), "secret-candidates")
    one = (
        found.filter(F.size("spans") > 0)
        .select("row", "owner", "repository", F.explode("spans").alias("s"))
        .select("row", "owner", "repository", "s.start", "s.kind", "s.end", F.sha2("s.value", 256).alias("hash"), "s.value")
        .filter((F.col("kind") != NAMES.index("opaque")) | _mixed(F.col("value")))
        .drop("value")
    )
    one = stored(one, "secret-spans")
    held = ownership(one)
    judged = one.join(held, "hash").withColumn("live", F.col("owners") <= max_owners)
    span = F.struct("start", "kind", "end")
    base = F.col("kind") < len(BASE)
    per_row = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(base, span))).alias("base"),
        F.array_sort(F.collect_list(F.when(~base & F.col("live"), span))).alias("more"),
        F.sum(F.when(base & F.col("live"), 1).otherwise(0)).cast("bigint").alias("n_live"),
        F.sum(F.when(base & ~F.col("live"), 1).otherwise(0)).cast("bigint").alias("n_copied"),
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    # A further span that overlaps a base one says nothing new.
    free = F.filter(
        "more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    )
    per_row = per_row.select("row", "base", F.array_sort(F.concat("base", free)).alias("spans"), "n_live", "n_copied")
    return (
        found.select("row", "doc_id").join(per_row, "row", "left")
        .select(
            "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"),
            F.coalesce("n_live", F.lit(0).cast("bigint")).alias("n_live"),
            F.coalesce("n_copied", F.lit(0).cast("bigint")).alias("n_copied"), "row",
        )
    )


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with every span replaced by ``mark``; overlapping spans become one mark."""
    out = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= a["at"],
                F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark)),
            ).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(spans) > 0, out).otherwise(text)


def counts(spans: Column) -> list[Column]:
    """Spans of each base kind: n_assign, n_access, n_hex."""

    def of(order: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == order)).cast("bigint")

    return [of(i).alias(f"n_{k.name}") for i, k in enumerate(BASE)]

"""Secrets by pattern, and weak credential parts that count only beside their complement.

Strong kinds are reported wherever they stand. An access identifier, a secret or an
endpoint that is weak on its own is reported only if a part of a complementary role lies
within its scope: an interval join of the parts of one text on position bins finds these,
so neither a text full of parts nor a very common part makes a large group. Positions come
from the pieces between the matches, so everything is built-in column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.common import BLOCK, running_sums
from mailsieve.session import written

VALUE = r"""["']?\x20*[:=]\x20*["']?"""
# Kind: pattern, group that must be long enough, its least length.
STRONG = {
    "assign": (rf"((?i:password|passwd|secret|token|api_?key)){VALUE}([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
RUN = "A-Za-z0-9+/_-"
WEAK = {
    "identifier": (rf"(?i:user_?name|user|login|client_?id|access_?key_?id|account){VALUE}[A-Za-z0-9+/_.@=-]{{3,}}", 0, 3),
    "opaque": (
        rf"(?<![{RUN}])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[{RUN}]{{20,}}", 0, 20,
    ),
    "endpoint": (
        rf"""(?:(?i:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[^\x20\x09-\x0D"'<>]+"""
        rf"""|\b(?i:host|endpoint|server){VALUE}[A-Za-z0-9.-]{{4,}})""", 0, 4,
    ),
}
KINDS = [*STRONG, *WEAK]
ROLE = {
    "assign": "secret", "hex": "secret", "opaque": "secret", "access": "identifier",
    "identifier": "identifier", "endpoint": "endpoint",
}
# A weak part counts beside a part of one of these roles.
COMPLEMENTS = {"identifier": ["secret"], "secret": ["identifier", "endpoint"], "endpoint": ["secret"]}
SCOPE = 200


def find_spans(df: DataFrame, text: str, kinds: dict, prefix: str) -> DataFrame:
    """Adds per kind an array of (start, end) in code points, end exclusive, in order.

    Running sums go block by block, so a text with very many matches stays cheap.
    """
    c = lambda name, kind: F.col(f"{prefix}{name}_{kind}")
    each = lambda **f: {f"{prefix}{name}_{k}": g(k) for name, g in f.items() for k in kinds}

    def lengths(kind: str) -> Column:
        pattern, group, _ = kinds[kind]
        pieces = F.split(df[text], pattern, -1)
        whole = F.regexp_extract_all(df[text], F.lit(pattern), F.lit(0))
        part = F.regexp_extract_all(df[text], F.lit(pattern), F.lit(group))
        both = F.zip_with(pieces, whole, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("len")))
        rows = F.zip_with(both, part, lambda b, g: F.struct(b["gap"].alias("gap"), b["len"].alias("len"), F.length(g).alias("value")))
        return F.when(F.rlike(df[text], F.lit(pattern)), F.filter(rows, lambda x: x["len"].isNotNull()))

    df = df.withColumns(each(m=lengths))
    cut = lambda k: F.transform(
        F.sequence(F.lit(0), F.size(c("m", k)) - 1, F.lit(BLOCK)),
        lambda b: F.transform(F.slice(c("m", k), b + 1, F.lit(BLOCK)), lambda x: x["gap"] + x["len"]),
    )
    df = df.withColumns(each(b=lambda k: F.when(c("m", k).isNotNull(), F.transform(cut(k), running_sums))))
    df = df.withColumns(each(o=lambda k: running_sums(F.transform(c("b", k), lambda x: F.element_at(x, -1)))))

    def spans(k: str) -> Column:
        before = F.flatten(F.transform(c("b", k), lambda x, i: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda y: y + F.get(c("o", k), i))))
        full = F.zip_with(c("m", k), before, lambda x, s: F.struct((s + x["gap"]).alias("start"), (s + x["gap"] + x["len"]).alias("end"), x["value"].alias("value")))
        good = F.transform(
            F.filter(full, lambda x: x["value"] >= kinds[k][2]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
        )
        return F.coalesce(good, F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, end: INT>>)"))

    df = df.withColumns({k: spans(k) for k in kinds})
    return df.drop(*[f"{prefix}{n}_{k}" for n in "mbo" for k in kinds])


def _listed(spans: Column, kind: str) -> Column:
    """(start, rank of the kind, end), which sorts as spans are listed."""
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def written_out(spans: Column) -> Column:
    """kind:start:end, comma-joined by start, then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def parts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, digest of the text, strong spans and weak candidate spans; a NULL text is empty.

    A weak candidate that overlaps a strong span is left to it.
    """
    df = docs.select(docs[doc_id].alias("id"), F.coalesce(docs[text], F.lit("")).alias("content"))
    df = df.withColumn("digest", F.xxhash64("content"))
    df = find_spans(df, "content", STRONG | WEAK, "_")
    strong = F.concat(*[_listed(F.col(k), k) for k in STRONG])
    df = df.select("id", "digest", *STRONG, *WEAK, strong.alias("strong"))

    def clear(kind: str) -> Column:
        return F.filter(F.col(kind), lambda x: ~F.exists(F.col("strong"), lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])))

    df = df.withColumns({k: clear(k) for k in WEAK})
    weak = F.concat(*[_listed(F.col(k), k) for k in WEAK])
    return df.select("id", "digest", *STRONG, "strong", weak.alias("weak"))


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans of parts() that have a complement within scope code points.

    One row per span: id, digest, start, kind, end. Both sides are dealt by id and
    position bin, so a text of any length is spread and a bin holds a bounded number of
    spans of each kind.
    """
    role_of = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLE[k])]), F.col("span.kind"))
    bins = lambda low, high: F.explode(F.sequence((low / scope).cast("int"), (high / scope).cast("int")))
    one = found.select("id", "digest", F.explode("weak").alias("span")).distinct()
    left = one.select("id", "digest", "span.*", role_of.alias("role"))
    left = left.select("*", bins(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope).alias("bin"))
    either = found.select("id", "digest", F.explode(F.concat("strong", "weak")).alias("span")).distinct()
    right = either.select("id", "digest", "span.*", role_of.alias("role"))
    right = right.select("*", bins(F.col("start"), F.col("end")).alias("bin"))
    a, b = left.alias("a"), right.alias("b")
    wanted = F.lit(False)
    for role, others in COMPLEMENTS.items():
        wanted = wanted | ((F.col("a.role") == role) & F.col("b.role").isin(others))
    near = (F.col("b.start") <= F.col("a.end") + scope) & (F.col("b.end") >= F.col("a.start") - scope)
    apart = (F.col("b.start") >= F.col("a.end")) | (F.col("b.end") <= F.col("a.start"))
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.digest") == F.col("b.digest")) & (F.col("a.bin") == F.col("b.bin"))
    linked = a.join(b, same & near & apart & wanted, "left_semi")
    return linked.select("id", "digest", "start", "kind", "end").distinct()


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """id, counts of the strong kinds, base_sha256 of their spans, spans of all kinds.

    One row per row of docs. NULL and empty texts have no spans; rows with equal id and
    text get equal results. The texts are read once and never shuffled.
    """
    found = written(parts(docs, doc_id, text), "secret-parts")
    linked = link(found, scope).groupBy("id", "digest").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    linked = linked.select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), "linked")
    df = found.join(linked, found["id"].eqNullSafe(linked["r_id"]) & (found["digest"] == linked["r_digest"]), "left")
    nothing = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, kind: INT, end: INT>>)")
    return df.select(
        "id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in STRONG],
        F.sha2(written_out(F.col("strong")), 256).alias("base_sha256"),
        written_out(F.concat("strong", F.coalesce("linked", nothing))).alias("spans"),
    )

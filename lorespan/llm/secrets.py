"""Secrets in texts, told apart by who else has them.

Column expressions only. Candidates are found in each text; their hashes are counted over the whole corpus by
distinct repositories and owners. A value that several owners have, or that one owner has in many of its repositories,
is an example that was copied around; a value of one owner in few of them looks live. Values of known form are always
reported, others only if they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.llm.common import stored

# Kinds in their order, and their patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "pem", "key")
#: Values without a known form: private key blocks, to their end or as far as their lines go, and long runs that mix
#: digits with letters of both cases.
HEAD = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
OTHER = HEAD + r"(?:(?:[^-]|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----|(?:\s*+[A-Za-z0-9+/=]{16,})*+)|[A-Za-z0-9+/_-]{24,}={0,2}"
#: A value with more owners than this is an example, and one that its owner has in more repositories than this share of
#: its own, if these are more than a few.
MOST_OWNERS, MOST_SHARE, FEW = 1, 0.05, 2
#: Matches whose places are added up together.
BLOCK = 64

SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,hash:string>"


def _running(lengths: Column, start: Column) -> Column:
    """Sums of an array up to each element, and ``start``."""
    zero = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(lengths, zero, lambda done, n: F.struct((done["at"] + n).alias("at"), F.array_append(done["out"], done["at"] + n).alias("out")), lambda done: done["out"])


def _matches(text: Column, pattern: str) -> Column:
    """Array of ``(start, end, value)`` in code points of the leftmost matches that do not overlap.

    Texts between matches and matches alternate, so their lengths add up to places: within blocks of ``BLOCK`` first,
    then over blocks, as an array that grows by one is copied each time.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values))
    pairs = F.zip_with(gaps, values, lambda gap, value: F.struct((F.length(gap) + F.length(value)).cast("bigint").alias("both"), value.alias("value")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda n: F.slice(pairs, n * BLOCK + 1, F.lit(BLOCK)))
    totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0).cast("bigint"), lambda done, x: done + x["both"]))
    before = F.concat(F.array(F.lit(0).cast("bigint")), _running(totals, F.lit(0).cast("bigint")))
    ends = F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda block, start: _running(F.transform(block, lambda x: x["both"]), start)))
    found = F.zip_with(ends, values, lambda end, value: F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))


def _spans(found: Column, rank: Column, kind: Column, value: Column) -> Column:
    return F.struct(found["start"].alias("start"), rank.cast("int").alias("rank"), found["end"].alias("end"), kind.alias("kind"), F.sha2(value, 256).alias("hash"))


def base_spans(text: Column) -> Column:
    """Spans of the known forms, by start and kind; ``hash`` is of the secret value. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    value = lambda m: F.regexp_extract(m["value"], ASSIGN, 2)
    assign = F.filter(_matches(text, ASSIGN), lambda m: F.length(value(m)) >= 8)
    access = F.filter(_matches(text, ACCESS), lambda m: F.length(m["value"]) >= 16)
    return F.array_sort(
        F.concat(
            F.transform(assign, lambda m: _spans(m, F.lit(0), F.lit("assign"), value(m))),
            F.transform(access, lambda m: _spans(m, F.lit(1), F.lit("access"), m["value"])),
            F.transform(_matches(text, HEX), lambda m: _spans(m, F.lit(2), F.lit("hex"), m["value"])),
        )
    )


def other_spans(text: Column, base: Column) -> Column:
    """Spans of values without a known form that touch no known one, and of private key blocks, which may hold some.

    A private key is known by its body: the same head stands before different keys.
    """
    found = _matches(F.coalesce(text, F.lit("")), OTHER)
    pem = lambda m: m["value"].startswith("-----")
    mixed = lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[a-z]") & m["value"].rlike("[A-Z]")
    apart = lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    kept = F.filter(found, lambda m: pem(m) | mixed(m) & apart(m))
    body = lambda m: F.regexp_replace(F.regexp_replace(m["value"], f"{HEAD}|-----END [A-Z ]*PRIVATE KEY-----", ""), r"\s+", "")
    return F.transform(kept, lambda m: _spans(m, F.when(pem(m), 3).otherwise(4), F.when(pem(m), F.lit("pem")).otherwise(F.lit("key")), F.when(pem(m), body(m)).otherwise(m["value"])))


def ownership(candidates: DataFrame, owners: DataFrame) -> DataFrame:
    """``(hash, owners, repositories, owned)`` from ``(hash, owner, repository)``; null owners and repositories are one each.
    ``owned`` are all repositories of the owner, the most if there are several, from ``owners`` (owner, owned).

    Counted in three steps, each combined before it moves, so a value that a third of all rows hold is no
    more than a row per owner where it is counted last.
    """
    uses = candidates.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("used"))
    used = uses.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    sized = used.join(owners.withColumnRenamed("owner", "of"), F.col("owner").eqNullSafe(F.col("of")))
    return sized.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.max("owned").alias("owned"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", owner_col: str = "source", repository_col: str = "doc_id", text_col: str = "text", most_owners: int = MOST_OWNERS, most_share: float = MOST_SHARE, few: int = FEW) -> DataFrame:
    """Per row: id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, ``n_live``, ``n_examples``.

    ``spans`` holds the base spans and those others that look live: of at most ``most_owners`` owners, and in at most
    ``most_share`` of the owner's repositories or ``few`` of them. Null and empty texts have none; rows with
    null or repeated ids, and repeated rows, come back as often as they were given.
    """
    read = docs.select(F.col(id_col).alias("id"), F.col(owner_col).alias("owner"), F.col(repository_col).alias("repository"), F.col(text_col).alias("text"))
    found = read.withColumn("base", base_spans(F.col("text"))).withColumn("other", other_spans(F.col("text"), F.col("base")))
    any_found = F.size("base") + F.size("other") > 0
    # spans follow from the text alone, so equal texts share one row where values are looked up
    key = F.when(any_found, F.concat_ws(":", *(F.hex(F.xxhash64(F.lit(n), "text")) for n in (1, 2))))
    found = stored(found.select("id", "owner", "repository", "base", "other", key.alias("key")), "secret_candidates")
    hits = found.filter("key is not null")
    hashes = F.array_distinct(F.transform(F.concat("base", "other"), lambda s: s["hash"]))
    owned = found.groupBy("owner", "repository").agg(F.lit(1).alias("one")).groupBy("owner").agg(F.count(F.lit(1)).alias("owned"))
    owners = ownership(hits.select("owner", "repository", F.explode(hashes).alias("hash")), owned)
    texts = hits.groupBy("key").agg(F.first(F.concat("base", "other")).alias("spans")).select("key", F.explode("spans").alias("span"))
    judged = texts.withColumn("hash", F.col("span.hash")).join(owners, "hash").withColumn(
        "live", (F.col("owners") <= most_owners) & (F.col("repositories") <= F.greatest(F.lit(float(few)), F.col("owned") * most_share))
    )
    judged = judged.groupBy("key").agg(
        F.collect_list(F.when(F.col("live") | (F.col("span.rank") < 3), F.col("span"))).alias("spans"),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_examples"),
    )
    none = found.filter("key is null").select("*", F.array().cast(f"array<{SPAN}>").alias("spans"), F.lit(0).cast("bigint").alias("n_live"), F.lit(0).cast("bigint").alias("n_examples"))
    whole = hits.join(judged, "key").select(*none.columns).union(none)
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return whole.select(
        F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort("spans")).alias("spans"), "n_live", "n_examples",
    )

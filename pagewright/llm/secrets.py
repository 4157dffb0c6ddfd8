"""Secret scans: candidate spans, told apart by how many repositories and owners hold the same value.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

# The kinds in the order in which spans of one start are listed, their patterns, the group that
# holds the value and its least length.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]{32,}", 0, 32))
#: Opaque values without a keyword: a candidate only; the corpus tells whose it is.
OPAQUE = ("opaque", r"[A-Za-z0-9_-]{24,}", 0, 24)
KINDS = [k for k, *_ in (*BASE, OPAQUE)]


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches with their places in code points, from the lengths of matches and gaps."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    none = F.array().cast("array<struct<kind:string,ord:int,start:int,end:int,value:string>>")
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), values.alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        keep = (F.length(x["value"]) >= least) if kind != "opaque" else opaque(x["value"])
        span = F.struct(F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("ord"), start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), folded).otherwise(none)


def opaque(value: Column) -> Column:
    """A null value is none; else lower case, upper case and digits mixed, of at least 12 different characters."""
    kinds = value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9].*[0-9]")
    return kinds & (F.size(F.array_distinct(F.split(value, ""))) >= 12)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base and loose: the spans of the base kinds by start and kind, and opaque ones outside of them."""
    t = F.coalesce(F.col(text), F.lit(""))
    by_start = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["ord"] - b["ord"])
    first = docs.withColumn("_base", F.array_sort(F.concat(*(_spans(t, *k) for k in BASE)), by_start)).withColumn("_loose", _spans(t, *OPAQUE))
    apart = F.filter("_loose", lambda o: ~F.exists("_base", lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])))
    return first.withColumn("_loose", apart)


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners) of (hash, repo, owner) rows: three sums over ever fewer rows, each combined before it is dealt out."""
    repos = found.groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"))
    owners = repos.groupBy("hash", "owner").agg(F.count("*").alias("n_repos"))
    return owners.groupBy("hash").agg(F.sum("n_repos").alias("n_repos"), F.count("*").alias("n_owners"))


#: Owners and repositories from which on a value is widely copied.
WIDELY, OFTEN = 3, 20


def scan(docs: DataFrame, owner: str = "source", repo: str = "doc_id", text: str = "text", widely: int = WIDELY, often: int = OFTEN) -> DataFrame:
    """docs, without its text, with spans (array of kind, start, end, n_repos, n_owners, live), one row per input row.

    A value held by fewer than `widely` owners and in fewer than `often` repositories is owner-specific and live;
    any other is a widely copied example: many owners copied it from each other, or one owner all over its
    repositories. Spans of both kinds stay, told apart by live. Places are code points, end exclusive. Null and
    empty texts have no spans; whole texts are searched, however long; a null owner is one owner, a null repository
    likewise; repeated rows give repeated results and count once for their repository. An empty table gives an
    empty result. Columns that docs has besides are kept, but one named spans is replaced. The values are hashed
    before rows are dealt out and the counts of a hash are summed in parts; the join that brings them back is of two
    plain exchanges, so a value in a third of all rows is a skewed partition that adaptive execution splits.
    """
    own = [c for c in docs.columns if c != text and c.lower() != "spans"]
    loaded = candidates(docs.select(*(F.col(c).alias(f"in_{i}") for i, c in enumerate(own)), F.col(owner).cast("string").alias("_owner"), F.col(repo).cast("string").alias("_repo"), F.col(text).alias("_text")), "_text")
    hashed = F.transform(F.concat("_base", "_loose"), lambda s: F.struct(s["kind"].alias("kind"), s["ord"].alias("ord"), s["start"].alias("start"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash")))
    kept = written(loaded.select(*(f"in_{i}" for i in range(len(own))), "_owner", "_repo", hashed.alias("_spans"), F.monotonically_increasing_id().alias("_row")), "spans")
    each = kept.where(F.size("_spans") > 0).select("_row", "_owner", "_repo", F.explode("_spans").alias("s")).select("_row", F.col("_owner").alias("owner"), F.col("_repo").alias("repo"), "s.*")
    counts = written(ownership(each.select("hash", "repo", "owner")), "ownership")
    live = (F.col("n_owners") < widely) & (F.col("n_repos") < often)
    told = (
        each.join(counts, "hash").groupBy("_row")
        .agg(F.sort_array(F.collect_list(F.struct("start", "ord", "end", "kind", "n_repos", "n_owners", live.alias("live")))).alias("_told"))
    )
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,n_repos:bigint,n_owners:bigint,live:boolean>>")
    return kept.join(told, "_row", "left").select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(own)), F.coalesce("_told", none).alias("spans"))


def redact(docs: DataFrame, owner: str = "source", repo: str = "doc_id", text: str = "text", widely: int = WIDELY, often: int = OFTEN) -> DataFrame:
    """docs with each span of its text replaced: by [secret], or by [example] where the value is widely copied.

    Overlapping spans become one, live if one of them is. The columns and their order stay; null text stays null.
    """
    cols = docs.columns
    at = {c: f"c_{i}" for i, c in enumerate(cols)}
    found = scan(docs.select(*(F.col(c).alias(n) for c, n in at.items()), F.col(text).alias("kept")), at[owner], at[repo], at[text], widely, often)
    t = F.coalesce("kept", F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        mark = F.when(s["live"], F.lit("[secret]")).otherwise(F.lit("[example]"))
        before = F.substring(t, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        inside = s["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], before, mark)).alias("out"))

    done = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    new = F.when(F.size("spans") > 0, done).otherwise(F.col("kept"))
    return found.select(*(new.alias(c) if c == text else F.col(n).alias(c) for c, n in at.items()))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "opaque")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )

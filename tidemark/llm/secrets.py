"""Secrets in texts, judged by how many owners hold the same value. DataFrame functions only.

Three kinds are found, leftmost and not overlapping within a kind (fixed values):
``assign`` (a named value), ``access`` (an access key id) and ``hex``.

Every value is counted over the whole corpus by its hash: in how many documents,
repositories and owners it stands. A value that ``widely`` or more owners hold is a
copied example. Of the others an access key id is live by its form, a named value if
it has six different characters, a hex run if it looks random. A live value that is
used elsewhere without a name (a whole run of value characters, of any length that
a value may have) is found there too and reported as kind ``reuse``. Values without
digits may be words: where ``widely`` or more owners use one without a name, those
uses are prose and only the named ones are live.

Places are found without Python: splitting at the pattern gives the texts between
the matches, and running sums over both give the places, in code points.
Counting goes by (value, repository, owner) first and then by value, so a value in
a third of all rows is added up before it is shuffled.

Rows: a null or empty text holds nothing. Null ids are kept. Equal rows are rows of
their own. A null owner or repository counts as one more. Other columns pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch

# The patterns of the contract, and the characters each kind needs.
ASSIGN = (
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]+)"
KINDS = (("assign", ASSIGN, 8), ("access", ACCESS, 16), ("hex", HEX, 32))
RUN = r"([A-Za-z0-9+/_.=-]+)"
RUN_LENGTH = min(least for _, _, least in KINDS)

_BLOCK = 256


def _sums_before(lengths: Column) -> Column:
    """Sum of all elements before each one. Folded in blocks, so a long list costs little more than its length."""
    grow = lambda xs, first: F.aggregate(
        xs, F.struct(F.array().cast("array<long>").alias("out"), first.cast("long").alias("sum")),
        lambda s, x: F.struct(F.concat(s["out"], F.array(s["sum"])).alias("out"), (s["sum"] + x).alias("sum")),
        lambda s: s["out"],
    )
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, _BLOCK)
    )
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x))
    return F.flatten(F.zip_with(blocks, grow(sums, F.lit(0)), grow))


def matches(text: Column, pattern: str, least: int, kind: str) -> Column:
    """array<struct<start, end, kind, value>> of all matches whose value (group 1) has ``least`` characters or more."""
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x).cast("long"))
    between = lengths(F.split(text, pattern, -1))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    own = lengths(found)
    place = F.zip_with(F.slice(between, 1, F.size(own)), own, lambda gap, n: F.struct(gap.alias("gap"), n.alias("n")))
    before = _sums_before(F.transform(place, lambda p: p["gap"] + p["n"]))
    spans = F.transform(
        F.arrays_zip(before.alias("before"), place.alias("place"), values.alias("value")),
        lambda m: F.struct(
            (m["before"] + m["place"]["gap"]).alias("start"), (m["before"] + m["place"]["gap"] + m["place"]["n"]).alias("end"),
            F.lit(kind).alias("kind"), m["value"].alias("value")),
    )
    spans = F.filter(spans, lambda m: F.length(m["value"]) >= least)
    # a cheap look first: few texts hold any match; runs that are too short need no place
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPANS))


_SPANS = "array<struct<start:bigint,end:bigint,kind:string,value:string>>"


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind in the order of KINDS (``reuse`` last), comma-joined."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate([*(k for k, _, _ in KINDS), "reuse"]) for x in (k, i)])
    ordered = F.array_sort(F.transform(spans, lambda m: F.struct(
        m["start"].alias("start"), rank[m["kind"]].alias("rank"), m["end"].alias("end"), m["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])), ",")


def looks_random(value: Column) -> Column:
    """Digits and letters, and six different characters at least."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 6)


def _may_live(value: Column, kind: Column) -> Column:
    return F.when(kind == "access", True).when(kind == "assign", F.size(F.array_distinct(F.split(value, ""))) >= 6).otherwise(looks_random(value))


def find_secrets(docs: DataFrame, widely: int = 3, owner_col: str = "source", repo_col: str = "source",
                 id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, and ``secrets``:
    array<struct<start, end, kind, value, state>> with state ``live``, ``copied`` or ``plain``. ``keep`` passes columns on.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # {n,} in place of + where a maximal run is meant: the short ones drop out in the pattern
    long_run = lambda pattern, n: pattern.replace("]+", "]{%d,}" % n)
    base = F.concat(
        matches(text, ASSIGN, 8, "assign"),
        matches(text, long_run(ACCESS, 12), 16, "access"),
        matches(text, long_run(HEX, 32), 32, "hex"),
    )
    read = scratch.keep(
        docs.select(
            F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("doc_id"),
            *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)],
            F.col(owner_col).cast("string").alias("_owner"), F.col(repo_col).cast("string").alias("_repo"),
            base.alias("base"), text.alias("_text"),
        ), "read")

    hashed = F.sha2("m.value", 256).alias("hash")
    values = (
        read.filter("size(base) > 0").select("_row", "_owner", "_repo", F.explode("base").alias("m"))
        .select("_row", "_owner", "_repo", hashed, _may_live(F.col("m.value"), F.col("m.kind")).alias("may"), looks_random(F.col("m.value")).alias("random"))
    )
    counted = (
        values.groupBy("hash", "_owner", "_repo", "random").agg(F.count("*").alias("rows"), F.max("may").alias("may"))
        .groupBy("hash", "random").agg(
            F.countDistinct(F.coalesce("_owner", F.lit("\0"))).alias("owners"), F.countDistinct(F.coalesce("_repo", F.lit("\0"))).alias("repos"),
            F.sum("rows").alias("rows"), F.max("may").alias("may"))
        .select("hash", "random", F.when(F.col("owners") >= widely, "copied").when(F.col("may"), "live").otherwise("plain").alias("state"))
    )
    counted = scratch.keep(counted, "values")
    live = counted.filter("state = 'live'").select("hash", "random")
    counted = counted.select("hash", "state")

    judged = (
        read.filter("size(base) > 0").select("_row", F.explode("base").alias("m")).select("_row", "m", hashed)
        .join(counted, "hash").select("_row", F.col("m").withField("state", F.col("state")).alias("m"))
    )
    overlaps = F.exists("base", lambda b: (b["start"] < F.col("m.end")) & (F.col("m.start") < b["end"]))
    # rows first, by their distinct runs; places only where a live value stands
    run = long_run(RUN, RUN_LENGTH)
    holders = scratch.keep(
        read.select("_row", F.explode(F.array_distinct(F.regexp_extract_all("_text", F.lit(run), F.lit(1)))).alias("value"))
        .select("_row", F.sha2("value", 256).alias("hash")).join(live.select("hash"), "hash", "left_semi").select("_row").distinct(), "holders")
    bare = scratch.keep(
        read.join(holders, "_row", "left_semi")
        .select("_row", "_owner", "base", F.explode(matches(F.col("_text"), run, RUN_LENGTH, "reuse")).alias("m")).filter(~overlaps)
        .select("_row", "_owner", "m", hashed).join(live, "hash"), "bare")
    prose = (
        bare.filter("NOT random").select("hash", F.coalesce("_owner", F.lit("\0")).alias("owner")).distinct()
        .groupBy("hash").agg(F.count("*").alias("owners")).filter(F.col("owners") >= widely)
    )
    again = bare.join(prose, "hash", "left_anti").select("_row", F.col("m").withField("state", F.lit("live")).alias("m"))
    scratch.keep(judged, "judged")
    again = scratch.keep(again, "again")
    per_row = scratch.read(again, "judged", "again").groupBy("_row").agg(F.array_sort(F.collect_list("m")).alias("secrets"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:string,value:string,state:string>>")
    count = lambda kind: F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long")
    state = lambda name: F.size(F.filter("secrets", lambda m: m["state"] == name)).cast("long")
    return read.join(per_row, "_row", "left").withColumn("secrets", F.coalesce("secrets", empty)).select(
        "doc_id", *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)],
        *[count(k).alias(f"n_{k}") for k, _, _ in KINDS],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("secrets")).alias("spans"),
        state("live").alias("n_live"), state("copied").alias("n_copied"), "secrets",
    )


def redacted(text: Column, secrets: Column) -> Column:
    """The text with every live secret replaced by its kind in brackets. Overlapping spans are replaced once, by the first."""
    live = F.filter(secrets, lambda m: m["state"] == "live")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    folded = F.aggregate(
        live, start,
        lambda s, m: F.when(m["end"] <= s["at"], s).otherwise(F.struct(
            F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.greatest(m["start"] - s["at"], F.lit(0)).cast("int")),
                     F.when(m["start"] >= s["at"], F.concat(F.lit("["), m["kind"], F.lit("]"))).otherwise("")).alias("out"),
            m["end"].alias("at"))),
        lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(live) > 0, folded).otherwise(text)

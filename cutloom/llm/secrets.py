"""Secret scans: plain patterns, and linked parts of credentials.

Three strong patterns report every match. Weaker signs (a user or client id, a token-like string, a URL) mean
little alone: each is a part of a credential, with an interval around it as its scope. A join of the
intervals within a document finds the parts that stand in each other's scope, and a weak one is
reported only where the parts that complete it are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.llm.arrays import at, indices, let
from cutloom.llm.common import free_names, written

#: Kinds in the order in which spans with one start are listed: strong ones, then the method's own.
KINDS = ("assign", "access", "hex", "ident", "weak_secret", "endpoint")
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
IDENT = r"(?i)(?:user_?name|user_?id|client_?id|account_?id|login|access_?key_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@+-]{3,}"
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}|(?i)\b(?:pwd|pass|private_?key|signature)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}"
ENDPOINT = r"(?i)\b(?:https?|ftp|jdbc:[a-z]+|mongodb|redis|postgres(?:ql)?|mysql|amqp)://[^\s\"'<>]+|\b(?:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]+\.[a-z]{2,}(?::[0-9]+)?"
#: A value of an assignment, and an access identifier, that are shorter are no matches.
LEAST_VALUE, LEAST_ACCESS = 8, 16
#: Code points before and after a part's start in which its other parts must start.
SCOPE = 200
#: Kinds by the part of a credential that they are: 0 identifier, 1 secret, 2 endpoint.
ROLES = (1, 0, 1, 0, 1, 2)
#: What names a text: its id and two hashes of both, so that null ids and equal ids with different texts are apart.
KEY = ["k1", "k2"]
SPAN = "array<struct<kind:int,i:int,gap:int,size:int,strong:boolean>>"


def found(text: Column, kind: str, pattern: str, keep: Column | None = None, value_group: int | None = None) -> Column:
    """The matches of ``pattern`` in order: each with the code points since the match before and its own.

    What lies between the matches is what splitting at the pattern leaves. ``strong`` is false for a match whose
    value is too short; it still separates the others.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else whole
    least = LEAST_VALUE if value_group else LEAST_ACCESS
    matches = let(
        F.struct(F.split(text, pattern, -1).alias("gaps"), whole.alias("whole"), values.alias("values")),
        lambda m: F.transform(
            indices(F.size(m["whole"])),
            lambda i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.char_length(at(m["gaps"], i)).alias("gap"), F.char_length(at(m["whole"], i)).alias("size"), (F.char_length(at(m["values"], i)) >= least).alias("strong")),
        ),
    )
    return F.when(text.rlike(pattern) if keep is None else keep, matches).otherwise(F.array()).cast(SPAN)


def parts_of(text: Column) -> Column:
    """All matches of all kinds; the weak ones only in texts that have an identifier, without which none is complete."""
    identified = text.rlike(IDENT) | text.contains("AKIA")
    return F.concat(
        found(text, "assign", ASSIGN, value_group=2),
        found(text, "access", ACCESS, text.contains("AKIA")),
        found(text, "hex", HEX),
        found(text, "ident", IDENT),
        found(text, "weak_secret", WEAK_SECRET, identified),
        found(text, "endpoint", ENDPOINT, identified),
    )


def keyed(documents: DataFrame, names: list[str]) -> DataFrame:
    """``documents`` with two hashes of doc_id and text, none of them null, as columns ``names``."""
    return documents.withColumns({names[0]: F.xxhash64("doc_id", "text"), names[1]: F.hash("text", "doc_id")})


def placed_parts(rows: DataFrame) -> DataFrame:
    """(k1, k2, kind, start, end, strong) of every match, in code points, end exclusive. ``rows`` has k1, k2 and ``parts``, once a key."""
    each = rows.select(*KEY, F.explode("parts").alias("p")).select(*KEY, "p.*")
    so_far = Window.partitionBy(*KEY, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).withColumn("start", F.col("end") - F.col("size"))
    # an assignment or an access identifier with too short a value is no match; it only kept the others apart
    return placed.where("strong OR kind > 2").select(*KEY, "kind", "start", "end", (F.col("kind") <= 2).alias("strong"))


def linked_pairs(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(k1, k2, a, b): every two parts of different roles of a text whose starts are at most ``scope`` apart, a of the lesser role; both are
    structs (start, end, kind).

    An interval join: a part is in one bin of ``scope`` code points, its partner in that bin or one beside it, and bins of one text are
    joined by equality. Matches of a kind do not overlap, so a part has no more partners than fit beside each other into its scope.
    """
    role = F.get(F.array(*map(F.lit, ROLES)), F.col("kind"))
    sided = parts.select(*KEY, role.alias("role"), F.struct("start", "end", "kind").alias("x"), F.floor(F.col("start") / F.lit(scope)).alias("bin"))
    left = sided.select(*KEY, "bin", F.col("role").alias("a_role"), F.col("x").alias("a"))
    right = sided.select(*KEY, F.explode(F.array(*(F.col("bin") + d for d in (-1, 0, 1)))).alias("bin"), F.col("role").alias("b_role"), F.col("x").alias("b"))
    pairs = left.join(right, [*KEY, "bin"]).where("a_role < b_role").where(F.abs(F.col("a.start") - F.col("b.start")) <= scope)
    return pairs.select(*KEY, "a_role", "b_role", "a", "b")


def spans(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(k1, k2, kind, start, end, strong, links) of every strong match and every complete weak one.

    ``rows`` has k1, k2, which name a text, and ``parts``, once a key. A weak identifier is complete with a secret (strong or weak)
    in its scope, a weak secret with an identifier, an endpoint with both. Weak spans that overlap a strong one are left out.
    ``links`` has the partners of identifiers: structs (start, end, kind) of the secrets and endpoints in their scope.
    """
    parts = placed_parts(rows)
    pairs = linked_pairs(parts, scope)
    one = pairs.select(*KEY, F.col("a.kind").alias("kind"), F.col("a.start").alias("start"), F.col("b_role").alias("met"), F.when(F.col("a_role") == 0, F.col("b")).alias("partner"))
    other = pairs.select(*KEY, F.col("b.kind").alias("kind"), F.col("b.start").alias("start"), F.col("a_role").alias("met"), F.lit(None).cast("struct<start:bigint,end:bigint,kind:int>").alias("partner"))
    met = one.unionByName(other).groupBy(*KEY, "kind", "start").agg(F.bool_or(F.col("met") == 0).alias("by_ident"), F.bool_or(F.col("met") == 1).alias("by_secret"), F.array_sort(F.collect_set("partner")).alias("links"))
    by_start = Window.partitionBy(*KEY).orderBy("start", "kind")
    placed = parts.withColumns(
        {
            "strong_before": F.max(F.when(F.col("strong"), F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1)),
            "strong_after": F.min(F.when(F.col("strong"), F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing)),
        }
    ).join(met, [*KEY, "kind", "start"], "left")
    clear = (F.coalesce("strong_before", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("strong_after") >= F.col("end"), F.lit(True))
    complete = F.when(F.col("kind") == 3, F.col("by_secret")).when(F.col("kind") == 4, F.col("by_ident")).otherwise(F.col("by_secret") & F.col("by_ident"))
    return placed.where(F.col("strong") | (complete & clear)).select(*KEY, "kind", "start", "end", "strong", "links")


def said(x: Column) -> Column:
    """kind:start:end of a struct."""
    return F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), x["kind"]), x["start"].cast("string"), x["end"].cast("string"))


def secret_report(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """For each row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, links.

    ``spans`` lists kind:start:end by start, then kind, comma-joined; ``base_sha256`` digests the strong ones so listed. ``links`` lists
    identifier>partner, each as kind:start:end, for the secrets and endpoints in an identifier's scope. A null text counts as
    empty: no spans. Equal rows are scanned once and reported as often as they come; rows with one doc_id, null ones too, and
    different texts are apart. Very long texts are read whole; ties of start go by kind. An empty table gives an empty result; other
    columns are ignored. No text is moved: only matches and hashes are; they are written when the report is asked for.
    """
    rows = keyed(documents.select("doc_id", "text"), KEY).select(*KEY, "doc_id", parts_of(F.coalesce("text", F.lit(""))).alias("parts"))
    # a text that comes again under its id is one row with a count
    rows = rows.groupBy(*KEY).agg(F.first("doc_id").alias("doc_id"), F.first("parts").alias("parts"), F.count("*").alias("copies"))
    rows = written(rows, "secret_parts")
    found = spans(rows.where(F.size("parts") > 0), scope)
    item = F.struct("start", "kind", "end", "strong", "links")
    count = lambda kind: F.count_if(F.col("kind") == KINDS.index(kind)).alias(f"n_{kind}")
    listed = found.groupBy(*KEY).agg(count("assign"), count("access"), count("hex"), F.array_sort(F.collect_list(item)).alias("items"))
    joined = lambda items, what: F.array_join(F.transform(items, what), ",")
    all_items = F.coalesce("items", F.array().cast(listed.schema["items"].dataType))
    linked = F.flatten(F.transform(F.filter(all_items, lambda x: x["links"].isNotNull()), lambda x: F.transform(x["links"], lambda y: F.concat(said(x), F.lit(">"), said(y)))))
    counts = [F.coalesce(f"n_{kind}", F.lit(0).cast("bigint")).alias(f"n_{kind}") for kind in KINDS[:3]]
    report = rows.join(listed, KEY, "left").select(
        "doc_id", *counts,
        F.sha2(joined(F.filter(all_items, lambda x: x["strong"]), said), 256).alias("base_sha256"),
        joined(all_items, said).alias("spans"),
        F.array_join(linked, ",").alias("links"),
        "copies",
    )
    return report.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("copies")


def redacted(documents: DataFrame, mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``documents`` with every span of their texts, overlapping ones as one, replaced by ``mark``; all rows and columns stay.

    Texts are named by hashes of doc_id and text, and a text that comes again under its id is scanned once, so repeated rows are redacted
    alike and rows with one doc_id, null ones too, apart. Null texts stay null and empty ones empty; very long texts are redacted whole; an
    empty table stays empty; other columns may have any names. The matches are written when the function is called.
    """
    k1, k2, cuts_name = free_names(documents, "k1", "k2", "cuts")
    named = keyed(documents, [k1, k2])
    rows = named.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), parts_of(F.coalesce("text", F.lit(""))).alias("parts")).where(F.size("parts") > 0).dropDuplicates(KEY)
    every = spans(written(rows, "secret_parts"), scope).select(*KEY, F.struct(F.col("start").cast("int").alias("s"), F.col("end").cast("int").alias("e")).alias("x"))
    cuts = every.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.array_sort(F.collect_set("x")).alias(cuts_name))
    text, start = F.col("text"), F.struct(F.array().cast("array<string>").alias("done"), F.lit(0).alias("upto"))

    def step(so_far: Column, cut: Column) -> Column:
        apart = cut["s"] >= so_far["upto"]
        done = F.when(apart, F.concat(so_far["done"], F.array(F.substring(text, so_far["upto"] + 1, cut["s"] - so_far["upto"]), F.lit(mark)))).otherwise(so_far["done"])
        return F.struct(done.alias("done"), F.greatest(cut["e"], so_far["upto"]).alias("upto"))

    clean = F.aggregate(cuts_name, start, step, lambda x: F.concat(F.array_join(x["done"], ""), F.substring(text, x["upto"] + 1, F.char_length(text))))
    found = named.join(cuts, [k1, k2], "left")
    return found.withColumn("text", F.when(F.col(cuts_name).isNull(), text).otherwise(clean)).select(*documents.columns)

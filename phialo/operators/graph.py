"""Reaction records to dimensions, facts and triples, and checks of the graph.

Every ordered input carries ``seq``: "first" means the row with the smallest one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from phialo import scratch
from phialo.functions import fixed
from phialo.functions import text as T


def successful(df: DataFrame) -> DataFrame:
    """rows with status Success."""
    return df.where(F.col("status") == "Success")


def canonical_soc(df: DataFrame, column: str = "soc", out: str = "soc") -> DataFrame:
    """Canonical organ class; blank is UNKNOWN, an unknown spelling gets title case."""
    spark = df.sparkSession
    rows = [(raw, name) for name, spellings in fixed.ORGAN_CLASSES.items() for raw in spellings]
    names = F.broadcast(spark.createDataFrame(rows, "_raw string, _name string"))  # a fixed table
    s = T.strip(T.or_empty(F.col(column)))
    joined = df.withColumn("_soc", s).join(names, F.lower("_soc") == F.col("_raw"), "left")
    value = F.when(F.col("_soc").isin("", "UNKNOWN"), F.lit("UNKNOWN")).otherwise(F.coalesce("_name", T.title_case(F.col("_soc"))))
    return joined.withColumn(out, value).drop("_soc", "_raw", "_name")


def first_value(value: Column, seq: str = "seq") -> Column:
    """The first row's value that isn't null; a null only where all are."""
    return F.min_by(value, F.when(value.isNotNull(), F.col(seq)))


def other_than(value: Column, default: str) -> Column:
    return F.when(value != default, value)


def occurrences(rows: DataFrame) -> DataFrame:
    """One row for each product and lower-cased term, with the first telling frequency and class."""
    named = canonical_soc(rows).select(
        "seq",
        T.strip(T.or_empty(F.col("product_id").cast("string"))).alias("product_id"),
        F.lower(T.strip(T.or_empty(F.col("adr_term")))).alias("adr_term"),
        F.lower(T.or_default(F.col("frequency"), "not known")).alias("frequency"),
        "soc",
    )
    kept = named.where("product_id <> '' AND adr_term <> ''")
    return kept.groupBy("product_id", "adr_term").agg(
        F.coalesce(first_value(other_than(F.col("frequency"), "not known")), F.lit("not known")).alias("frequency"),
        F.coalesce(first_value(other_than(F.col("soc"), "UNKNOWN")), F.lit("UNKNOWN")).alias("soc"),
    )


def running_sum(df: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """Stored ``df`` with the sum of ``value`` over the rows of its key up to each row.

    In two steps, so that no task holds a hot key: rows are dealt by ranges of (key, order),
    sums run within a key's rows of one range, and what a key has in earlier ranges is added.
    """
    held = scratch.table(df.repartitionByRange(key, order).withColumn("_range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy(key, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = held.groupBy(key, "_range").agg(F.sum(value).alias("_sum"))  # a key has a row for each range at most
    earlier = Window.partitionBy(key).orderBy("_range")
    before = before.select(key, "_range", (F.sum("_sum").over(earlier) - F.col("_sum")).alias("_before"))
    return held.join(before, [key, "_range"]).withColumn(out, F.sum(value).over(within) + F.col("_before")).drop("_range", "_before")


def skipped(bars: list[int]) -> list[int]:
    """The step that a range of bars is for any number of skips before it, as sorted breaks.

    A bar h adds a skip to s if s < h.  A range of bars maps s to s + k - (breaks up to s),
    with a break for each of the k bars that can add one: such a bar joins two neighbouring
    outcomes to one, those of h - 1 and of h.
    """
    breaks: list[int] = []
    for bar in bars:
        rank = bar - len(breaks)  # of the break among the numbers 1, 2, ... that are none yet
        if rank > 0:
            # the rank-th free number is rank + the breaks below it
            low, high = 0, len(breaks)
            while low < high:
                mid = (low + high) // 2
                low, high = (mid + 1, high) if breaks[mid] - mid <= rank else (low, mid)
            breaks.insert(low, rank + low)
    return breaks


def _ranges(held: DataFrame) -> DataFrame:
    """(base, range, k, breaks) of bars in order: what each range does to the skips before it."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        breaks = skipped(part.sort_values("_j")["_bar"].tolist())
        return pd.DataFrame({"_base": [key[0]], "_range": [key[1]], "_breaks": [breaks]})

    return held.groupBy("_base", "_range").applyInPandas(run, "_base string, _range int, _breaks array<long>")


def skips_before(bars: DataFrame) -> DataFrame:
    """``bars`` (_base, _j, _bar, ...) with ``_skips``: skips of the base before each, by rising _j.

    An associative scan: every range of a base's bars is one step, whatever comes before it;
    the steps of a base are applied in turn; and each range, told where it starts, goes
    through its own bars.  Three jobs, whatever the names are.
    """
    held = scratch.table(bars.repartitionByRange("_base", "_j").withColumn("_range", F.spark_partition_id()), "bars")
    steps = _ranges(held).groupBy("_base").agg(F.array_sort(F.collect_list(F.struct("_range", "_breaks"))).alias("steps"))  # a row for each range of the base
    after = lambda s, z: s + F.size(z["_breaks"]) - F.size(F.filter(z["_breaks"], lambda b: b <= s))
    entry = lambda out, z: F.concat(out, F.array(after(F.element_at(out, -1), z)))
    starts = steps.select("_base", "steps", F.aggregate("steps", F.array(F.lit(0)), entry).alias("at"))
    starts = starts.select("_base", F.explode(F.arrays_zip(F.col("steps._range").alias("_range"), "at")).alias("z")).where("z._range IS NOT NULL")
    joined = held.join(starts.select("_base", F.col("z._range").alias("_range"), F.col("z.at").alias("_start")), ["_base", "_range"])
    schema = T_.StructType([*held.schema.fields, T_.StructField("_skips", T_.LongType())])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_j")
        s, out = int(part["_start"].iloc[0]), []
        for bar in part["_bar"]:
            out.append(s)
            s += s < bar
        return part.drop(columns="_start").assign(_skips=out)[schema.names]

    return scratch.table(joined.select(*held.columns, "_start").groupBy("_base", "_range").applyInPandas(run, schema).drop("_range"), "skips")


def unique_slugs(df: DataFrame, base: str, seq: str = "seq", out: str = "slug") -> DataFrame:
    """Every row its own slug; clashes get _2, _3 and so on in order, past values in use.

    The n-th row of a base takes number n, which no other base can make.  Only a name that
    stands in the input by itself may be in the way: a row that comes to a number whose name
    an earlier row holds goes on to the next one, and a name whose number was given out before
    its own first row numbers all its rows.  So bases without such children are done after
    counting; the others are settled from short names to long ones, each length of number
    endings by a fixed number of jobs.  ``seq`` has no ties.

    Number j of a base with s skips before it comes to row j - s; the name that stands there
    is skipped if fewer rows than that come before the name's own first row, that is, if s is
    below a bar: j less those rows.
    """
    columns = [F.col(c) for c in df.columns]
    rows = df.select(F.struct(*columns).alias("_row"), F.col(base).alias("_base"), F.col(seq).alias("_seq"), F.lit(1).alias("_one"))
    rows = running_sum(rows, "_base", "_seq", "_one", "_n").drop("_one")
    groups = rows.groupBy("_base").agg(F.count(F.lit(1)).alias("_rows"), F.min("_seq").alias("_first"))
    numbered = r"^(.*)_([2-9]|[1-9][0-9]{1,8})$"
    kids = groups.where(F.col("_base").rlike(numbered)).select(
        F.col("_base").alias("_kid"), "_first", F.regexp_extract("_base", numbered, 1).alias("_base"), F.regexp_extract("_base", numbered, 2).cast("long").alias("_j")
    )
    depth = F.length(F.col("_base")) - F.length(F.regexp_replace("_base", r"(_([2-9]|[1-9][0-9]{1,8}))+$", ""))
    kids = kids.join(groups.select("_base"), "_base").withColumn("_depth", depth)
    slug = F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("_"), F.col("_n").cast("string")))
    result = lambda placed: placed.select("_row.*", slug.alias(out))
    if not kids.take(1):
        return result(rows)
    kids = scratch.table(kids, "named_numbers")
    names = kids.select("_base").unionByName(kids.select(F.col("_kid").alias("_base"))).distinct()
    placed = scratch.table(rows.join(names, "_base", "left_semi").select("_row", "_base", "_seq", "_n"), "placed")
    for level in [r["_depth"] for r in kids.select("_depth").distinct().orderBy("_depth").collect()]:  # lengths of number endings: a few
        here = kids.where(F.col("_depth") == level).select("_base", "_j", "_kid", F.col("_first").alias("_seq"), F.lit(0).alias("_one"))
        # rows of the base before the name's own first row
        both = here.unionByName(placed.select("_base", "_seq", F.lit(1).alias("_one")), allowMissingColumns=True)
        counted = running_sum(both, "_base", "_seq", "_one", "_earlier").where("_kid IS NOT NULL")
        of_base = placed.groupBy("_base").agg((F.min("_n") - 1).alias("_push"), F.count(F.lit(1)).alias("_rows"))
        bars = counted.join(of_base, "_base").select("_base", "_j", "_kid", "_push", "_rows", (F.col("_j") - F.col("_push") - F.col("_earlier")).alias("_bar"))
        now = skips_before(bars).withColumn("_at", F.col("_j") - F.col("_skips"))
        met = now.where("_at - _push <= _rows")  # a row comes there at all
        # numbers given out before the name's own first row push all rows of that name on by one
        pushed = met.where("_skips >= _bar").select(F.col("_kid").alias("_base"), F.lit(1).alias("_push"))
        # rows from a skipped number's turn on are one further
        marks = met.where("_skips < _bar").select("_base", F.col("_at").alias("_n"), F.lit(0).alias("_order"), F.lit(1).alias("_skip"))
        own = placed.select("*", F.lit(1).alias("_order"), F.lit(0).alias("_skip")).unionByName(marks, allowMissingColumns=True)
        own = own.withColumn("_place", F.struct("_n", "_order"))
        moved = running_sum(own, "_base", "_place", "_skip", "_shift").where("_order = 1")
        moved = moved.join(pushed, "_base", "left").withColumn("_n", F.col("_n") + F.col("_shift") + F.coalesce("_push", F.lit(0)))
        placed = scratch.table(moved.select("_row", "_base", "_seq", "_n"), "placed")
    return result(rows.join(names, "_base", "left_anti")).unionByName(result(placed))


def adr_dim(rows: DataFrame, slugs: bool = True) -> DataFrame:
    """A5: one row for each lower-cased term, with the first row's names and the first codes; without ``slugs`` the terms name them."""
    term = T.strip(T.or_empty(F.col("adr_term")))
    named = rows.select("*", F.lower(term).alias("_term")).where("_term <> ''")
    preferred = F.lower(T.strip(F.when(T.or_empty(F.col("meddra_preferred_term")) == "", F.col("_term")).otherwise(F.col("meddra_preferred_term"))))
    preferred = F.when(preferred == "", F.col("_term")).otherwise(preferred)
    meddra, icd = T.or_default(F.col("meddra_code"), "0"), T.or_default(F.col("icd_code"), "UNKNOWN")
    merged = named.groupBy(F.col("_term").alias("adr_term")).agg(
        F.min("seq").alias("seq"),
        F.min_by(preferred, "seq").alias("meddra_preferred_term"),
        F.coalesce(first_value(other_than(meddra, "0")), F.lit("0")).alias("meddra_code"),
        F.coalesce(first_value(other_than(icd, "UNKNOWN")), F.lit("UNKNOWN")).alias("icd_code"),
    )
    return unique_slugs(merged.withColumn("base", T.slug(F.col("adr_term"))), "base").drop("base") if slugs else merged


def drug_dim(drugs: DataFrame, inn: DataFrame | None = None, slugs: bool = True) -> DataFrame:
    """One row for each product (the last one's values), label before the first bar; without ``slugs`` the products name them.

    An earlier row of the same product still uses up its slug.  Of several ingredients of a
    product the one with the largest ``seq`` counts, or the largest where there is no ``seq``.
    """
    pid = T.strip(T.or_empty(F.col("product_id").cast("string")))
    label = T.strip(F.get(F.split(T.or_empty(F.col("brand_name")), r"\|"), F.lit(0)))
    named = drugs.withColumn("product_id", pid).where("product_id <> ''")
    named = named.withColumn("label", F.when(label == "", F.concat(F.lit("product_"), "product_id")).otherwise(label))
    named = named.select("seq", "product_id", "label", T.or_default(F.col("atc_code"), "UNKNOWN").alias("atc_code"))
    named = unique_slugs(named.withColumn("base", T.slug(F.col("label"))), "base").drop("base") if slugs else named
    own = [c for c in named.columns if c != "product_id"]
    last = named.groupBy("product_id").agg(F.max_by(F.struct(*own), "seq").alias("r")).select("product_id", "r.*")
    if inn is None:
        return last.withColumn("active_ingredient", F.lit(""))
    known = inn.select(
        T.strip(F.col("product_id").cast("string")).alias("product_id"),
        F.lower(T.strip(T.or_empty(F.col("active_ingredient")))).alias("active_ingredient"),
        (F.col("seq") if "seq" in inn.columns else F.lit(0)).alias("_order"),
    )
    known = known.groupBy("product_id").agg(F.max_by("active_ingredient", F.struct("_order", "active_ingredient")).alias("active_ingredient"))
    return last.join(known, "product_id", "left").na.fill({"active_ingredient": ""})


def smpc_dim(drugs: DataFrame) -> DataFrame:
    """One document for each product."""
    one = drugs.select("product_id").distinct()
    return one.select("product_id", F.concat(F.lit("smpc_"), "product_id").alias("slug"), T.source_url(F.col("product_id")).alias("source_url"))


def occurrence_fact(occ: DataFrame, drugs: DataFrame, adrs: DataFrame, smpcs: DataFrame) -> DataFrame:
    """Occurrences with all three sides; the others are dropped."""
    d = drugs.select("product_id", F.col("slug").alias("drug_id"))
    a = adrs.select("adr_term", F.col("slug").alias("adr_id"))
    s = smpcs.select("product_id", F.col("slug").alias("smpc_id"))
    full = occ.join(d, "product_id").join(s, "product_id").join(a, "adr_term")
    return full.withColumn("occ_id", T.occurrence_id(F.col("product_id"), F.col("adr_term")))


def known_occurrences(occ: DataFrame, drugs: DataFrame) -> DataFrame:
    """J4 for questions that name products and terms: occurrences of known products, without the names of their sides.

    Every term of an occurrence is a reaction of the same rows, and every product has a
    document, so products are all that can be missing.
    """
    return occ.join(drugs.select("product_id"), "product_id", "left_semi")


def schema_triples(spark: SparkSession) -> DataFrame:
    """The graph's constant triples."""
    rows = [(fixed.NAMESPACE, "rdf:type", "owl:Ontology", "iri"), (fixed.NAMESPACE, "rdfs:label", fixed.GRAPH_LABEL, "literal")]
    for name, label in fixed.CLASSES:
        rows += [(name, "rdf:type", "owl:Class", "iri"), (name, "rdfs:label", label, "literal")]
    for name, domain, range_, label in fixed.OBJECT_PROPERTIES:
        rows += [(name, "rdf:type", "owl:ObjectProperty", "iri"), (name, "rdfs:domain", domain, "iri"), (name, "rdfs:range", range_, "iri"), (name, "rdfs:label", label, "literal")]
    for name, domain, label in fixed.DATA_PROPERTIES:
        rows += [(name, "rdf:type", "owl:DatatypeProperty", "iri"), (name, "rdfs:range", "xsd:string", "iri"), (name, "rdfs:label", label, "literal")]
        rows += [(name, "rdfs:domain", domain, "iri")] if domain else []
    return spark.createDataFrame(rows, "s string, p string, o string, o_kind string")


def _stacked(df: DataFrame, subject: str, kind: str, links: dict[str, str], literals: dict[str, str]) -> DataFrame:
    def triple(p: str, o: Column, how: str, s: str = subject) -> Column:
        return F.struct(F.col(s).alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(how).alias("o_kind"))

    rows = [triple("rdf:type", F.lit("owl:NamedIndividual"), "iri"), triple("rdf:type", F.lit(kind), "iri")]
    rows += [triple(p, F.col(c), "iri") for p, c in links.items()]
    rows += [F.when(F.col(c) != "", triple(p, F.col(c), "literal")) if p == "activeIngredient" else triple(p, F.col(c), "literal") for p, c in literals.items()]
    if kind == "DrugAdrOccurrence":
        rows.append(triple("hasOccurrence", F.col("occ_id"), "iri", "drug_id"))
    return df.select(F.explode(F.array(*rows)).alias("t")).where("t IS NOT NULL").select("t.*")


def triples(drugs: DataFrame, adrs: DataFrame, smpcs: DataFrame, facts: DataFrame, with_schema: bool = True) -> DataFrame:
    """The whole graph as a set of (s, p, o, o_kind).

    ``facts`` have a row for each occurrence, so what they say is a set already; only names
    that a drug, a reaction, a document or the schema share can repeat a triple.
    """
    parts = [
        _stacked(drugs, "slug", "Drug", {}, {"productId": "product_id", "drugLabel": "label", "atcCode": "atc_code", "activeIngredient": "active_ingredient"}),
        _stacked(adrs, "slug", "AdverseDrugReaction", {}, {"adrLabel": "adr_term", "meddraPreferredTerm": "meddra_preferred_term", "meddraCode": "meddra_code", "icdCode": "icd_code"}),
        _stacked(smpcs, "slug", "SmPCDocument", {}, {"productId": "product_id", "sourceUrl": "source_url"}),
    ]
    told = _stacked(facts, "occ_id", "DrugAdrOccurrence", {"occurrenceOfAdr": "adr_id", "refersToSmPC": "smpc_id"}, {"productId": "product_id", "frequency": "frequency", "soc": "soc"})
    if with_schema:
        parts.append(schema_triples(drugs.sparkSession))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.distinct().unionByName(told)


ONCE = ("occurrenceOfAdr", "refersToSmPC", "frequency", "soc")


def cardinality_violations(graph: DataFrame) -> DataFrame:
    """Q1: occurrences without exactly one value of a property: s, p, n."""
    flags = [F.count_if(F.col("p") == p).alias(p) for p in ONCE]
    is_occ = F.count_if((F.col("p") == "rdf:type") & (F.col("o") == "DrugAdrOccurrence")).alias("is_occ")
    counts = graph.groupBy("s").agg(is_occ, *flags).where("is_occ > 0")
    each = F.array(*[F.struct(F.lit(p).alias("p"), F.col(p).alias("n")) for p in ONCE])
    return counts.select("s", F.explode(each).alias("z")).where("z.n <> 1").select("s", "z.p", "z.n")


def validate_graph(graph: DataFrame, forbidden: str = "OpenPVSignal") -> DataFrame:
    """Q2: verdict, triples, occurrences, violations, and whether forbidden text occurs."""
    bad = cardinality_violations(graph).agg(F.count(F.lit(1)).alias("violations"))
    has = F.coalesce(F.max(F.col("s").contains(forbidden) | F.col("p").contains(forbidden) | F.col("o").contains(forbidden)), F.lit(False))
    occ = F.count_if((F.col("p") == "rdf:type") & (F.col("o") == "DrugAdrOccurrence"))
    whole = graph.agg(F.count(F.lit(1)).alias("triples"), occ.alias("occurrences"), has.alias("forbidden"))
    verdict = F.when(F.col("forbidden") | (F.col("violations") > 0), "INVALID").otherwise("VALID")
    return whole.crossJoin(bad).select(verdict.alias("verdict"), "triples", "occurrences", "violations", "forbidden")  # one row each


def dangling(refs: DataFrame, defs: DataFrame, ref: str = "smpc_id", key: str = "slug") -> DataFrame:
    """Distinct references without a definition."""
    return refs.select(ref).distinct().join(defs.select(F.col(key).alias(ref)), ref, "left_anti")


def shared_slugs(drugs: DataFrame, adrs: DataFrame) -> DataFrame:
    """Names that a drug and a reaction share: one individual in the graph for two things."""
    return drugs.select("slug").join(adrs.select("slug"), "slug", "left_semi").distinct()

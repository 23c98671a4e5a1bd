"""Vocabulary lookups as joins, and what is done with their results.

Vocabulary rows: sab, code, name, cui.  A term is looked up once, whatever its number of
rows.  Word lookups go by sets of words: a set's rarest word, or its two rarest where all are
frequent, finds the names that may hold it.  Rough lookups look for the closest names:
first at one edit, by what is left of a string without one of its characters; terms that have
nothing there block by pieces, since a name cut into one piece more than the edits it may
have keeps one piece whole in every term near it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phialo import scratch
from phialo.functions import text as T


def normal_form(c: Column) -> Column:
    """Lower-case words without punctuation, sorted."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "), r"(?U)\s+"), lambda x: x != "")
    return F.array_join(F.array_sort(words), " ")


def words_of(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "), r"(?U)\s+"), lambda x: x != ""))


def unique_terms(rows: DataFrame, column: str = "adr_term") -> DataFrame:
    """V4: distinct stripped terms that aren't blank."""
    return rows.select(T.strip(F.col(column)).alias("term")).where("term <> ''").distinct()


def by_sorting(df: DataFrame) -> DataFrame:
    """``df`` for a join, as a table that grows with the input: sorted, never sent to all.

    Spark plans by the size of compressed files, where a vocabulary of a million names of one
    pattern takes a few MB; its rows fill the driver's memory.
    """
    return df.hint("merge")


def _usable(vocab: DataFrame, sabs: list[str]) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(s) for s in sabs]), F.col("sab"))
    return vocab.where(F.col("sab").isin(*sabs) & (T.or_empty(F.col("code")) != "") & (F.col("code") != "NONE")).withColumn("sab_rank", rank)


#: Lists that a key has on both sides are dealt in blocks of about this many rows a side.
BLOCK = 2000


def _in_blocks(left: DataFrame, right: DataFrame, key: list[str], own: tuple[str, str], block: int) -> DataFrame:
    """The equi-join of two tables on ``key`` without a key's pairs in one task.

    Of a key with more than ``block`` rows on a side, every block of one side meets every
    block of the other; ``own`` names the columns by which rows are dealt.
    """
    often = lambda side, c: side.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(c))
    hot = scratch.table(often(left, "_lb").join(often(right, "_rb"), key).where("_lb > 1 OR _rb > 1"), "hot_keys")
    spread = lambda side, by, a, b: (
        side.join(hot, key, "left")
        .na.fill(1, ["_lb", "_rb"])
        .withColumns({f"{a}_at": F.expr(f"pmod(xxhash64({by}), {a})"), f"{b}_at": F.explode(F.expr(f"sequence(0L, {b} - 1L)"))})
        .drop("_lb", "_rb")
    )
    return spread(left, own[0], "_lb", "_rb").join(spread(right, own[1], "_rb", "_lb"), [*key, "_lb_at", "_rb_at"]).drop("_lb_at", "_rb_at")


def _best_holding(terms: DataFrame, names: DataFrame, block: int = BLOCK) -> DataFrame:
    """(term, b): of every term with words the best name (by BEST) that holds all of them.

    Terms are their sets of words, and a set of names' words keeps its best name.  A set is
    found by its rarest word; where that one is frequent, so are all of the set's: then a set
    of one word takes the word's best name, which needs no pairs, and a larger one is found by
    its two rarest words.  Lists that stay long are dealt in blocks.
    """
    order = F.struct("sab_rank", F.length("name").alias("size"), "code", "name")
    sets = lambda df, c: df.withColumn("words", F.array_sort(words_of(F.col(c))))
    held = sets(names, "name").where(F.size("words") > 0).groupBy("words").agg(F.min(F.struct(order.alias("by"), "sab", "cui")).alias("b"))
    held = scratch.table(held.withColumn("own", F.xxhash64("words")), "name_sets")
    asked = scratch.table(sets(terms.select("term"), "term").where(F.size("words") > 0), "term_sets")
    tokens = held.select(F.explode("words").alias("word"), "b")
    often = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("names"), F.min("b").alias("b"))
    often = scratch.table(often, "words")
    parts = asked.select("words").distinct().select("words", F.explode("words").alias("word")).join(often.select("word", "names"), "word", "left")
    # a word that no name has rules its set out
    ranked = parts.groupBy("words").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "word"))).alias("r")).where("r[0].names > 0")
    ranked = scratch.table(ranked.select("words", F.xxhash64("words").alias("own"), F.col("r")[0]["names"].alias("names"), F.col("r")[0]["word"].alias("word"), F.get("r", F.lit(1))["word"].alias("other")), "asked_sets")
    single = ranked.where("other IS NULL").select("words", "word").join(often.select("word", "b"), "word").select("words", "b")
    rare = ranked.where((F.col("names") <= block) & F.col("other").isNotNull()).select("words", "own", "word")
    listed = held.select(F.col("words").alias("all"), F.col("own").alias("set"), "b", F.explode("words").alias("word"))
    holds = F.size(F.array_except("words", "all")) == 0
    by_word = _in_blocks(rare, listed, ["word"], ("own", "set"), block).where(holds).select("words", "b")
    pairs = ranked.where((F.col("names") > block) & F.col("other").isNotNull()).select("words", "own", F.least("word", "other").alias("word"), F.greatest("word", "other").alias("other"))
    frequent = often.where(F.col("names") > block).select("word")
    hot = listed.join(frequent, "word", "left_semi").groupBy("set", "all").agg(F.min("b").alias("b"), F.array_sort(F.collect_list("word")).alias("w"))
    twos = F.expr("flatten(transform(w, (x, i) -> transform(slice(w, i + 2, size(w)), y -> struct(x AS word, y AS other))))")
    both = hot.select("all", "set", "b", F.explode(twos).alias("z")).select("all", "set", "b", "z.*")
    by_two = _in_blocks(pairs, both, ["word", "other"], ("own", "set"), block).where(holds).select("words", "b")
    best = single.unionByName(by_word).unionByName(by_two).groupBy("words").agg(F.min("b").alias("b"))
    return asked.join(best, "words").select("term", "b.by.sab_rank", "b.by.code", "b.by.name", "b.sab", "b.cui")


def _by_pieces(terms: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    """All (_t, _n) pairs of lower-cased terms and names whose similarity is at least ``threshold`` (above 0).

    A pair's edits are at most ``_k - 1``, so one of the name's ``_k`` pieces stands whole in the
    term, with at most ``i`` edits in front of it and ``_k - 1 - i`` behind.
    """
    pieces = f"cast(floor(({1 - threshold!r}) / {threshold!r} * _len + 1e-9) AS int) + 1"
    cut = "cast(floor(i * _len / _k) AS int)"
    until = "cast(floor((i + 1) * _len / _k) AS int)"
    key = ["_len", "i", "piece"]
    n = names.select(F.lower("name").alias("_n")).where("_n IS NOT NULL").distinct().withColumn("_len", F.length("_n"))
    n = n.withColumn("_k", F.expr(pieces)).select("*", F.explode(F.expr("sequence(0, _k - 1)")).alias("i"))
    n = n.selectExpr("_n", "_len", "i", f"substring(_n, {cut} + 1, {until} - {cut}) AS piece")
    t = terms.select(F.lower("term").alias("_t")).distinct().withColumn("_own", F.length("_t"))
    lengths = f"sequence(cast(ceil(_own * {threshold!r} - 1e-9) AS int), cast(floor(_own / {threshold!r} + 1e-9) AS int))"
    t = t.select("*", F.explode(F.expr(lengths)).alias("_len")).join(F.broadcast(n.select("_len").distinct()), "_len")  # one row a length
    t = t.withColumn("_k", F.expr(pieces)).select("*", F.explode(F.expr("sequence(0, _k - 1)")).alias("i"))
    t = t.selectExpr("*", f"{cut} AS _a", f"{until} - {cut} AS _size")
    t = t.withColumn("_from", F.expr("greatest(_a - i, _a + _own - _len - (_k - 1 - i), 0)"))
    t = t.withColumn("_to", F.expr("least(_a + i, _a + _own - _len + (_k - 1 - i), _own - _size)")).where("_from <= _to")
    t = t.select("_t", "_len", "i", "_size", F.explode(F.expr("sequence(_from, _to)")).alias("_at"))
    t = t.selectExpr("_t", "_len", "i", "substring(_t, _at + 1, _size) AS piece").distinct()
    n, t = scratch.table(n, "name_pieces"), scratch.table(t, "term_pieces")
    both = _in_blocks(t, n, key, ("_t", "_n"), BLOCK)
    longest = F.greatest(F.length("_t"), F.length("_n"))
    return both.where(1 - F.levenshtein("_t", "_n") / longest >= threshold).select("_t", "_n").distinct()


def _one_edit(terms: DataFrame, names: DataFrame) -> DataFrame:
    """All (_t, _n) pairs of distinct lower-cased terms and names at one edit or none.

    Both sides are distinct, and few strings are left the same by taking out one character,
    so no key is frequent.
    """
    left = "transform(sequence(0, length({0})), i -> concat(substring({0}, 1, i - 1), substring({0}, i + 1)))"
    without = lambda c: F.explode(F.expr(f"array_distinct(concat(array({c}), {left.format(c)}))")).alias("_left")
    pairs = terms.select("_t", without("_t")).join(by_sorting(names.select("_n", without("_n"))), "_left")
    return pairs.where(F.levenshtein("_t", "_n") <= 1).select("_t", "_n").distinct()


def _closest(terms: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    """(_t, _n, edits): of each lower-cased term the names with the fewest edits that reach the threshold."""
    t = terms.select(F.lower("term").alias("_t")).distinct()
    n = names.select(F.lower("name").alias("_n")).where("_n IS NOT NULL").distinct()
    edits, longest = F.levenshtein("_t", "_n"), F.greatest(F.length("_t"), F.length("_n"))
    near = _one_edit(t, n).withColumn("edits", edits).where(1 - F.col("edits") / longest >= threshold)
    near = scratch.table(near, "near")
    rest = t.join(by_sorting(near.select("_t").distinct()), "_t", "left_anti").withColumnRenamed("_t", "term")
    far = _by_pieces(rest, names, threshold).withColumn("edits", edits)
    both = near.unionByName(far)
    least = both.groupBy("_t").agg(F.min("edits").alias("_least"))
    return both.join(by_sorting(least), "_t").where("edits = _least").drop("_least")


def hits(terms: DataFrame, vocab: DataFrame, sabs: list[str], modes: list[str], threshold: float = 0.8) -> DataFrame:
    """Hits of distinct terms: term, mode_rank, edits, and the vocabulary's columns.

    exact: equal names; normalized: equal normal forms; words: the best of the names that hold
    all words of the term; approximate: of terms that no mode before has found, the closest names of a
    similarity of ``threshold`` or more.
    """
    names = _usable(vocab, sabs)
    found = []
    for rank, mode in enumerate(modes):
        if mode in ("exact", "normalized"):
            form = (lambda c: F.lower(T.strip(c))) if mode == "exact" else normal_form
            hit = terms.withColumn("_k", form(F.col("term"))).join(by_sorting(names.withColumn("_k", form(F.col("name")))), "_k").where("_k <> ''").drop("_k")
        elif mode == "words":
            hit = _best_holding(terms, names)
        else:
            left = terms
            for before in found:
                left = left.join(by_sorting(before.select("term").distinct()), "term", "left_anti")
            pairs = _closest(left, names, threshold)
            hit = left.withColumn("_t", F.lower("term")).join(by_sorting(pairs), "_t").join(by_sorting(names.withColumn("_n", F.lower("name"))), "_n")
        edits = F.col("edits") if mode == "approximate" else F.lit(0).alias("edits")
        found.append(hit.select("term", F.lit(rank).alias("mode_rank"), F.lit(mode).alias("mode"), edits, "sab", "sab_rank", "code", "name", "cui"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


#: Ranking inside a mode: fewer edits, vocabulary order, shorter name, code.
BEST = ("mode_rank", "edits", "sab_rank", "length(name)", "code", "name")


def lookup(terms: DataFrame, vocab: DataFrame, sab: str | list[str], modes: list[str] | None = None) -> DataFrame:
    """V1, V3: best hit of each term: term, code, matched_name, source, status."""
    sabs = [sab] if isinstance(sab, str) else sab
    distinct = terms.select("term").distinct()
    best = hits(distinct.where("term <> ''"), vocab, sabs, modes or ["exact", "words"])
    order = F.struct(*[F.expr(x).alias(f"o{i}") for i, x in enumerate(BEST)])
    best = best.groupBy("term").agg(F.min_by(F.struct("code", "name", "sab", "mode"), order).alias("b"))
    rows = distinct.join(best, "term", "left")
    status = F.when(F.col("term") == "", "empty_query").when(F.col("b").isNull(), "not_found").otherwise(F.concat(F.lit("matched_"), F.col("b.mode")))
    return rows.select("term", T.or_empty(F.col("b.code")).alias("code"), T.or_empty(F.col("b.name")).alias("matched_name"), F.coalesce("b.sab", F.lit(sabs[0])).alias("source"), status.alias("status"))


def apply_matches(adrs: DataFrame, meddra: DataFrame, icd: DataFrame) -> DataFrame:
    """Codes of the first pass on all rows, by the stripped term in its own case."""
    m = meddra.select(F.col("term").alias("_t"), F.col("code").alias("_m"))
    i = icd.select(F.col("term").alias("_u"), F.col("code").alias("_i"))
    term = T.strip(T.or_empty(F.col("adr_term")))
    rows = adrs.withColumn("_term", term).join(m, F.col("_term") == F.col("_t"), "left").join(i, F.col("_term") == F.col("_u"), "left")
    filled = lambda c, d: F.when(T.or_empty(F.col(c)) == "", F.lit(d)).otherwise(F.col(c))
    return rows.withColumns({"meddra_code": filled("_m", "0"), "icd_code": filled("_i", "UNKNOWN"), "meddra_preferred_term": F.col("_term")}).drop("_term", "_t", "_u", "_m", "_i")


def term_index(rows: DataFrame) -> DataFrame:
    """V5: for each lower-cased term its first row with a MedDRA code, or else its first row."""
    key = F.lower(T.strip(T.or_empty(F.col("adr_term"))))
    named = rows.withColumn("term", key).where("term <> ''")
    own = F.struct(*[F.col(c) for c in rows.columns])
    return named.groupBy("term").agg(F.min_by(own, F.struct((T.or_empty(F.col("meddra_code")) == "0").alias("a"), "seq")).alias("r")).select("term", "r.*")


def icd_targets(index: DataFrame) -> DataFrame:
    """V6: terms without ICD code, tagged crosswalk (MedDRA code there) or freetext."""
    open_ = F.col("icd_code").isin("UNKNOWN", "") | F.col("icd_code").isNull()
    return index.where(open_).withColumn("way", F.when(F.col("meddra_code") == "0", "freetext").otherwise("crosswalk"))


def meddra_second_pass(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Terms without MedDRA code by their search terms, each by normal form, then roughly.

    Log: original_term, cleaned_candidate (the first), code or 0, preferred term.
    """
    index = term_index(rows).where(F.col("meddra_code").isin("0", "") | F.col("meddra_code").isNull())
    asked = index.select(F.col("term").alias("original_term"), T.search_terms(F.col("term")).alias("c"))
    each = asked.select("original_term", F.posexplode("c").alias("place", "term")).where(F.length("term") >= 3)
    found = hits(each.select("term").distinct(), vocab, ["MDR"], ["normalized", "approximate"])
    order = F.struct("place", *[F.expr(x).alias(f"o{i}") for i, x in enumerate(BEST)])
    best = each.join(by_sorting(found), "term").groupBy("original_term").agg(F.min_by(F.struct("code", "name"), order).alias("b"))
    return asked.join(by_sorting(best), "original_term", "left").select(
        "original_term", F.get("c", F.lit(0)).alias("cleaned_candidate"), F.coalesce("b.code", F.lit("0")).alias("meddra_code"), T.or_empty(F.col("b.name")).alias("meddra_preferred_term")
    )


def icd_crosswalk(targets: DataFrame, vocab: DataFrame) -> DataFrame:
    """Term, meddra_code, icd_code_new, source.

    Terms with a MedDRA code go by its concept to the first ICD code; those without, and those
    without a MedDRA code, by the normal form of the term.
    """
    first = lambda by, value: F.min_by(value, F.struct(*by))
    concepts = vocab.where("sab = 'MDR' AND coalesce(cui, '') <> ''").groupBy(F.col("code").alias("meddra_code")).agg(F.min("cui").alias("cui"))
    icd = vocab.where("sab IN ('ICD10CM', 'ICD10') AND coalesce(code, '') NOT IN ('', 'NOCODE')")
    codes = icd.groupBy("cui").agg(first([F.when(F.col("sab") == "ICD10CM", 0).otherwise(1), F.col("code")], F.substring_index("code", "/", -1)).alias("_walk"))
    walk = targets.where("way = 'crosswalk'").join(concepts, "meddra_code", "left").join(codes, "cui", "left").select("term", "meddra_code", "_walk")
    rows = walk.unionByName(targets.where("way = 'freetext'").select("term", "meddra_code", F.lit(None).cast("string").alias("_walk")))
    free = lookup(rows.where("_walk IS NULL").select("term"), vocab, ["ICD10CM", "ICD10"], ["normalized"])
    free = free.select("term", F.when(F.col("code") != "", F.substring_index("code", "/", -1)).alias("_free"))
    rows = rows.join(free, "term", "left")
    return rows.select("term", "meddra_code", F.coalesce("_walk", "_free", F.lit("UNKNOWN")).alias("icd_code_new"), F.when(F.col("_walk").isNotNull(), "crosswalk").otherwise("freetext").alias("source"))


def backfill_codes(rows: DataFrame, cache: DataFrame, field: str) -> DataFrame:
    """Rows without a code take their term's new one.

    ``cache``: term, code[, preferred].  A MedDRA row's preferred term is replaced only where
    it is empty or the lower-cased term itself.
    """
    empty = {"meddra_code": ("0", ""), "icd_code": ("UNKNOWN", "")}[field]
    known = cache.select(F.col("term").alias("_t"), F.col("code").alias("_c"), *([F.col("preferred").alias("_p")] if field == "meddra_code" else []))
    joined = rows.withColumn("_k", F.lower(T.strip(T.or_empty(F.col("adr_term"))))).join(known, F.col("_k") == F.col("_t"), "left")
    takes = (F.col(field).isin(*empty) | F.col(field).isNull()) & (T.or_empty(F.col("_c")) != "") & ~F.col("_c").isin(*empty)
    takes = F.coalesce(takes, F.lit(False))
    new = {field: F.when(takes, F.col("_c")).otherwise(F.col(field))}
    if field == "meddra_code":
        p = T.or_empty(F.col("meddra_preferred_term"))
        name = F.when(T.or_empty(F.col("_p")) != "", F.lower("_p")).otherwise(F.col("_k"))
        new["meddra_preferred_term"] = F.when(takes & ((p == "") | (p == F.col("_k"))), name).otherwise(F.col("meddra_preferred_term"))
    return joined.withColumns(new).drop("_k", "_t", "_c", "_p")


def atc_lookup(inn: DataFrame, rx_name: DataFrame, rx_prop: DataFrame, rx_rel: DataFrame) -> DataFrame:
    """V7: inn, atc_code, atc_source by the first ingredient.

    Of a term's ten best entries the first five distinct concepts count, in order; each may
    have a code itself or by one of its first three ingredients.
    """
    asked = inn.select("inn", T.strip(F.get(F.split("inn", ","), F.lit(0))).alias("term")).distinct()
    # only what is asked for is ranked
    entries = rx_name.join(asked.select("term").distinct(), "term", "left_semi")
    ranked = entries.withColumn("n", F.row_number().over(Window.partitionBy("term").orderBy("rank", "rxcui"))).where("n <= 10")
    distinct = ranked.groupBy("term", "rxcui").agg(F.min("rank").alias("rank"))
    five = distinct.withColumn("cand", F.row_number().over(Window.partitionBy("term").orderBy("rank", "rxcui"))).where("cand <= 5").select("term", "rxcui", "cand")
    atc = rx_prop.where("prop = 'ATC' AND coalesce(value, '') <> ''").groupBy("rxcui").agg(F.min("value").alias("value"))
    three = rx_rel.join(five.select("rxcui").distinct(), "rxcui", "left_semi").withColumn("ing", F.row_number().over(Window.partitionBy("rxcui").orderBy("rank", "ing_rxcui"))).where("ing <= 3")
    direct = five.join(atc, "rxcui").select("term", "cand", F.lit(0).alias("ing"), "value")
    by_ing = five.join(three.drop("rank"), "rxcui").drop("rxcui").join(atc.withColumnRenamed("rxcui", "ing_rxcui"), "ing_rxcui").select("term", "cand", "ing", "value")
    best = direct.unionByName(by_ing).groupBy("term").agg(F.min_by(F.struct("value", "ing"), F.struct("cand", "ing")).alias("b"))
    rows = asked.join(best, "term", "left")
    how = F.when(F.col("b").isNull(), "not found in RxNorm").when(F.col("b.ing") == 0, "rxnorm_direct").otherwise("rxnorm_via_ingredient")
    return rows.select("inn", F.coalesce("b.value", F.lit("UNKNOWN")).alias("atc_code"), how.alias("atc_source"))


def apply_overrides(drugs: DataFrame, found: DataFrame, ingredients: dict[str, str] | None = None, overrides: dict[str, str] | None = None) -> DataFrame:
    """Ingredient by product, its looked-up code, and the codes that win over it."""
    from phialo.functions import fixed

    spark = drugs.sparkSession
    names = F.broadcast(spark.createDataFrame(list((ingredients or fixed.INGREDIENTS).items()), "product_id string, active_ingredient string"))  # fixed tables
    wins = F.broadcast(spark.createDataFrame(list((overrides or fixed.ATC_OVERRIDES).items()), "product_id string, _win string"))
    rows = drugs.withColumn("product_id", T.strip(F.col("product_id").cast("string"))).drop("active_ingredient", "atc_code", "atc_source")
    rows = rows.join(names, "product_id", "left").join(wins, "product_id", "left").join(found.withColumnRenamed("inn", "active_ingredient"), "active_ingredient", "left")
    source = F.when(F.col("_win").isNotNull(), "manual_who_atc").when(F.col("active_ingredient").isNull(), "inn not in map").otherwise(F.coalesce("atc_source", F.lit("not found in RxNorm")))
    return rows.withColumns({"atc_code": F.coalesce("_win", "atc_code", F.lit("UNKNOWN")), "atc_source": source, "active_ingredient": T.or_empty(F.col("active_ingredient"))}).drop("_win")


def atc_by_brand(drugs: DataFrame, vocab: DataFrame, sab: str = "ATC") -> DataFrame:
    """V8: drugs with query, code, name and status; each distinct query is looked up once."""
    asked = drugs.withColumn("query", T.drug_query(F.col("brand_name")))
    found = lookup(asked.select(F.col("query").alias("term")), vocab, sab)
    rows = asked.join(found.withColumnRenamed("term", "query"), "query", "left")
    return rows.withColumn("atc_code", F.when(F.col("code") == "", "UNKNOWN").otherwise(F.col("code"))).drop("code")


def lookup_log(drugs: DataFrame, adrs: DataFrame, meddra: DataFrame, icd: DataFrame) -> DataFrame:
    """V9: one row for each drug, two (meddra_code, icd_code) for each reaction row."""
    names = ["entity_type", "entity_value", "query_used", "target_field", "source_vocab", "matched_code", "matched_name", "status"]
    of_drugs = drugs.select(F.lit("drug"), "brand_name", "query", F.lit("atc_code"), "source", "atc_code", "matched_name", "status").toDF(*names)

    def of(found: DataFrame, field: str, default: str) -> DataFrame:
        rows = adrs.select(T.strip(T.or_empty(F.col("adr_term"))).alias("term")).join(found, "term", "left")
        code = F.when(T.or_empty(F.col("code")) == "", F.lit(default)).otherwise(F.col("code"))
        return rows.select(F.lit("adr"), "term", "term", F.lit(field), T.or_empty(F.col("source")), code, T.or_empty(F.col("matched_name")), F.coalesce("status", F.lit("empty_query"))).toDF(*names)

    return of_drugs.unionByName(of(meddra, "meddra_code", "0")).unionByName(of(icd, "icd_code", "UNKNOWN"))


def icd_provenance(final: DataFrame, log1: DataFrame, log2: DataFrame) -> DataFrame:
    """Where the final ICD codes (term, icd_code) come from: origin, count.

    Of several second-pass codes of a term the one with the largest ``seq`` counts, or the
    largest where there is no ``seq``.
    """
    coded = final.where("icd_code <> 'UNKNOWN'").select(F.col("adr_term").alias("term"), "icd_code").distinct()
    one = log1.where("target_field = 'icd_code' AND matched_code NOT IN ('', 'UNKNOWN')").groupBy(
        F.lower(T.strip(F.col("entity_value"))).alias("term"), F.col("matched_code").alias("icd_code")
    ).agg(F.collect_set("source_vocab").alias("sources"))
    two = log2.where("icd_code_new <> 'UNKNOWN'").groupBy(F.col("adr_term").alias("term")).agg(F.max_by("icd_code_new", F.struct(F.col("seq") if "seq" in log2.columns else F.lit(0), "icd_code_new")).alias("second"))
    rows = coded.join(one, ["term", "icd_code"], "left").join(two, "term", "left")
    origin = (
        F.when(F.size("sources") == 1, F.concat(F.lit("pass1:"), F.get("sources", F.lit(0))))
        .when(F.size("sources") > 1, "pass1:ambiguous")
        .when(F.col("second") == F.col("icd_code"), "pass2:source_not_logged")
        .otherwise("unattributed")
    )
    return rows.groupBy(origin.alias("origin")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "origin")

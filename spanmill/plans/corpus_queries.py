"""Queries of corpus compilation and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill.functions import labels, spans, text
from spanmill.operators import corpus
from spanmill.plans.fixtures import CARDS_SQL, RECORDS_SQL, cards, records, sql_key, sql_map, table
from spanmill.plans.registry import query, r6
from spanmill.sources import results


def docs(spark, d):
    return table(spark, d, "documents")


@query("b1_language_filter", "SELECT doc_id, source FROM documents WHERE lower(trim(coalesce(lang, ''))) = 'en'")
def _(spark, d):
    return docs(spark, d).filter(corpus.equals_folded(F.col("lang"), "en")).select("doc_id", "source")


@query("b2_locale_filter", "SELECT doc_id FROM documents WHERE lower(trim(coalesce(source, ''))) = 'src3'")
def _(spark, d):
    return docs(spark, d).filter(corpus.equals_folded(F.col("source"), "src3")).select("doc_id")


@query("b3_hydrated_only", "SELECT l.doc_id, d.n_chars FROM labels l JOIN documents d USING (doc_id) WHERE d.text IS NOT NULL")
def _(spark, d):
    bench = table(spark, d, "labels").select("doc_id")
    return corpus.hydrated(bench, docs(spark, d).select("doc_id", "text", "n_chars"), ("doc_id",)).select("doc_id", "n_chars")


def corpus_rows(spark, d):
    """cards as rows of the three corpora's shapes."""
    c = cards(spark, d).withColumn("original_index", F.col("key"))
    alias = lambda g, i: F.struct(F.when((F.col("key") + i) % 7 == 0, "UNIQUE_ID").when((F.col("key") + i) % 5 == 0, F.lower(g["type"])).otherwise(g["type"]).alias("label"))
    c = c.withColumn("masks", F.when(F.col("key") % 11 == 0, F.array().cast("array<struct<label:string>>")).otherwise(F.transform("gold0", alias)))
    name = lambda m: F.concat(F.lit('{"'), F.when(F.col("key") % 3 == 0, "label").when(F.col("key") % 3 == 1, "entity_type").otherwise("category"), F.lit('": "'), m["label"], F.lit('", "n": null}'))
    js = F.concat(F.lit("["), F.array_join(F.transform("masks", name), ", "), F.lit("]"))
    py = F.replace(F.replace(js, F.lit('"'), F.lit("'")), F.lit("null"), F.lit("None"))
    c = c.withColumn("spans", F.when(F.col("key") % 2 == 0, js).otherwise(py))
    return c.withColumn("entities", F.transform("masks", lambda m: F.struct(F.lit("x").alias("entity"), F.array(m["label"], F.lit("PERSON")).alias("types"))))


CORPUS_SQL = (
    CARDS_SQL
    + """, corpus AS (SELECT *, key AS original_index, CASE WHEN key % 11 = 0 THEN []::VARCHAR[] ELSE list_transform(range(0, 4), lambda i:
  CASE WHEN (key + i) % 7 = 0 THEN 'UNIQUE_ID' WHEN (key + i) % 5 = 0 THEN lower(gold0[i + 1].type) ELSE gold0[i + 1].type END) END AS types FROM cards)"""
)
_SK = f"list_transform(types, lambda t: {sql_key('t')})"
STRICT_SQL = f"list_transform({_SK}, lambda k: {sql_map('k', 'strict')})"


@query("b4_normalise_masks", f"WITH {CORPUS_SQL} SELECT 'a_' || key AS id, array_to_string(types, ',') AS types FROM corpus")
def _(spark, d):
    return corpus.normalise_masks(corpus_rows(spark, d)).select("id", F.array_join("types", ",").alias("types"))


@query("b5_normalise_spans", f"WITH {CORPUS_SQL} SELECT 'b_' || key AS id, array_to_string(types, ',') AS types FROM corpus")
def _(spark, d):
    return corpus.normalise_spans(corpus_rows(spark, d)).select("id", F.array_join("types", ",").alias("types"))


@query("b6_normalise_entities", f"WITH {CORPUS_SQL} SELECT 'c_' || key AS id, array_to_string(flatten(list_transform(types, lambda t: [t, 'PERSON'])), ',') AS types FROM corpus")
def _(spark, d):
    return corpus.normalise_entities(corpus_rows(spark, d)).select("id", F.array_join("types", ",").alias("types"))


@query("b7_lenient_list", f"WITH {CORPUS_SQL} SELECT key, len(types) AS n_items FROM corpus")
def _(spark, d):
    return corpus_rows(spark, d).select("key", F.size(text.lenient_list(F.col("spans"))).cast("long").alias("n_items"))


def typed(spark, d):
    return corpus.normalise_masks(corpus_rows(spark, d))


@query("b8_exclude_empty", f"WITH {CORPUS_SQL} SELECT source, count(*) AS kept FROM corpus WHERE len(types) > 0 GROUP BY source")
def _(spark, d):
    return typed(spark, d).filter(F.size("types") > 0).groupBy("source").agg(F.count("*").alias("kept"))


@query("b9_exclude_unmappable", f"WITH {CORPUS_SQL} SELECT source, count(*) FILTER (len(types) = 0) AS excluded_empty, count(*) FILTER (len(types) > 0 AND len(list_filter({STRICT_SQL}, lambda t: t IS NULL)) > 0) AS excluded_unmappable FROM corpus GROUP BY source")
def _(spark, d):
    empty = F.size("types") == 0
    return typed(spark, d).groupBy("source").agg(F.count_if(empty).alias("excluded_empty"), F.count_if(~empty & ~corpus.compilable(F.col("types"))).alias("excluded_unmappable"))


@query("b10_dehydrate", f"WITH {CORPUS_SQL} SELECT 'a_' || key AS id, source, original_index, array_to_string(types, ',') AS ground_truth, array_to_string({STRICT_SQL}, ',') AS canonical FROM corpus WHERE len(types) > 0 AND len(list_filter({STRICT_SQL}, lambda t: t IS NULL)) = 0")
def _(spark, d):
    out = corpus.compiled(typed(spark, d))
    return out.withColumns({"ground_truth": F.array_join("ground_truth", ","), "canonical": F.array_join("canonical", ",")})


@query("b13_missing_gold", f"WITH {CORPUS_SQL} SELECT DISTINCT key FROM corpus WHERE len(types) = 0 ORDER BY key LIMIT 20")
def _(spark, d):
    return typed(spark, d).filter(F.size("types") == 0).select("key").distinct().orderBy("key").limit(20)


# ---- scalar functions on texts and labels ----

BIN = "CASE WHEN length(coalesce(text, '')) < 500 THEN 'short' WHEN length(coalesce(text, '')) < 2000 THEN 'medium' ELSE 'long' END"


@query("h9_length_bin", f"SELECT source, {BIN} AS bin, count(*) AS n FROM documents GROUP BY ALL")
def _(spark, d):
    return docs(spark, d).groupBy("source", spans.length_bin(F.col("text")).alias("bin")).agg(F.count("*").alias("n"))


SIG = "CASE WHEN len(types) = 0 THEN 'none' ELSE array_to_string(list_sort(list_distinct(types))[1:3], '|') END"


@query("h10_type_signature", f"WITH {CORPUS_SQL} SELECT {SIG} AS signature, count(*) AS n FROM corpus GROUP BY ALL")
def _(spark, d):
    return typed(spark, d).groupBy(spans.type_signature(F.col("types")).alias("signature")).agg(F.count("*").alias("n"))


@query("h11_word_count", r"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> ''))::BIGINT AS n_words FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", spans.word_count(F.col("text")).alias("n_words"))


WORDS = [
    "Email", "phone-number", "first name", "DATE", "Street Address", "gender", "ip v4", "IPV4 address", "zip+4", "date of visit", "customer id", "social_sec_no", "mobile",
    "billing address", "driver license no", "passport no", "contact email", "", None, "weird-thing", "title", "birth place", "telephone no",
]
_WORDS_SQL = ", ".join("NULL" if w is None else f"'{w}'" for w in WORDS)
LABELS = f"""labels_in AS (SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN upper(w) WHEN 2 THEN lower(w) ELSE w END AS label
  FROM (SELECT doc_id, [{_WORDS_SQL}][(doc_id % {len(WORDS)}) + 1] AS w FROM documents))"""


def label_rows(spark, d):
    """A label for each document, in one of three spellings."""
    w = F.get(F.array(*map(F.lit, WORDS)), (F.col("doc_id") % len(WORDS)).cast("int"))
    spelt = F.when(F.col("doc_id") % 3 == 1, F.upper(w)).when(F.col("doc_id") % 3 == 2, F.lower(w)).otherwise(w)
    return docs(spark, d).select("doc_id", spelt.alias("label"))


@query("h4_label_key", f"WITH {LABELS} SELECT doc_id, label, {sql_key('label')} AS label_key FROM labels_in")
def _(spark, d):
    return label_rows(spark, d).select("doc_id", "label", labels.key(F.col("label")).alias("label_key"))


for _name, _how in (("h5_strict_map", "strict"), ("h6_lenient_map", "before"), ("h7_symmetric_map", "full"), ("h8_map_no_address", "no_address"), ("h8_map_no_date", "no_date"), ("h8_map_neither", "neither")):

    @query(_name, f"WITH {LABELS}, k AS (SELECT doc_id, label, {sql_key('label')} AS k FROM labels_in) SELECT doc_id, label, {sql_map('k', _how)} AS mapped FROM k")
    def _(spark, d, how=_how):
        return label_rows(spark, d).select("doc_id", "label", labels.mapped(F.col("label"), how).alias("mapped"))


def _map_values(held: dict) -> str:
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({cell(k)}, {cell(t)})" for k, t in held.items())


@query(
    "g5_map_union",
    f"""WITH {RECORDS_SQL}, base(k, target) AS (VALUES {_map_values(labels.BASE)}), later(k, target) AS (VALUES {_map_values(labels.LATER)}), both_maps AS (FROM later UNION ALL SELECT * FROM base WHERE k NOT IN (SELECT k FROM later)),
seen AS (SELECT {sql_key('p.type')} AS k, count(*) AS n FROM (SELECT unnest(preds) AS p FROM records) GROUP BY 1) SELECT k, target, n FROM seen LEFT JOIN both_maps USING (k)""",
)
def _(spark, d):
    """The union of the base table and later ones, which win, looked up for every predicted label."""
    held = labels.aligned()
    union = F.create_map(*[F.lit(x) for k, t in held.items() for x in (k, t)])
    seen = records(spark, d).select(F.explode("preds").alias("p")).groupBy(labels.key(F.col("p.type")).alias("k")).agg(F.count("*").alias("n"))
    return seen.select("k", F.try_element_at(union, F.col("k")).alias("target"), "n")


@query("a8_label_map", f"WITH {CORPUS_SQL}, base(k, target) AS (VALUES {_map_values(labels.BASE)}), seen AS (SELECT {sql_key('t')} AS k, count(*) AS n FROM (SELECT unnest(types) AS t FROM corpus) GROUP BY 1) SELECT k, target, base.k IS NOT NULL AS known, n FROM seen LEFT JOIN base USING (k)")
def _(spark, d):
    """The label map as it is read from its file, joined to the labels of the corpus."""
    import json
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".json") as f:
        f.write(json.dumps(labels.BASE))
        f.flush()
        held = results.read_labels(f.name)
    told = spark.createDataFrame(list(held.items()), "k string, target string").withColumn("known", F.lit(True))
    seen = typed(spark, d).select(F.explode("types").alias("t")).groupBy(labels.key(F.col("t")).alias("k")).agg(F.count("*").alias("n"))
    return seen.join(F.broadcast(told), "k", "left").withColumn("known", F.coalesce("known", F.lit(False)))  # as many rows as the map has


# ---- sampling, joins and set operations ----


def _order(seed: int, key: str) -> str:
    return f"md5('{seed}|' || {key})"


def sample_sql(n: int, src: str, strata: str, key: str, cols: str) -> str:
    return (
        f"s AS (SELECT *, {strata} AS st, {_order(42, key)} AS o FROM {src}), z AS (SELECT *, count(*) OVER (PARTITION BY st) AS size, count(*) OVER () AS total, row_number() OVER (PARTITION BY st ORDER BY o, {key}) AS rn FROM s) "
        f"SELECT {cols} FROM z ORDER BY rn > least(size, greatest(1, floor({n} * size / total))), o, {key} LIMIT {n}"
    )


@query("e1_stratified_sample", f"WITH {CORPUS_SQL}, {sample_sql(200, 'corpus', f'{BIN} || {chr(39)}_{chr(39)} || {SIG}', 'key', 'key')}")
def _(spark, d):
    strata = [F.concat_ws("_", spans.length_bin(F.col("text")), spans.type_signature(F.col("types")))]
    return corpus.stratified_sample(typed(spark, d), 200, strata, "key").select("key")


@query("e1b_stratified_by_source", f"WITH {sample_sql(150, 'documents', f'source || {BIN}', 'doc_id', 'doc_id, source')}")
def _(spark, d):
    return corpus.stratified_sample(docs(spark, d).select("doc_id", "source", "text"), 150, [F.col("source"), spans.length_bin(F.col("text"))], "doc_id").select("doc_id", "source")


@query("f4_prefix_cap", "SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 100")
def _(spark, d):
    return corpus.capped(docs(spark, d).select("doc_id", "source"), 100, ["source", "doc_id"])


@query("f4_balanced_cap", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS t FROM documents) ORDER BY t, source LIMIT 100")
def _(spark, d):
    return corpus.balanced(docs(spark, d).select("doc_id", "source"), 100, "source", ["doc_id"])


@query("c1_hydrate", "SELECT l.doc_id, l.quality, d.source, length(d.text)::BIGINT AS chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE d.text IS NOT NULL")
def _(spark, d):
    bench = table(spark, d, "labels").select("doc_id", "quality")
    return corpus.hydrated(bench, docs(spark, d).select("doc_id", "source", "text"), ("doc_id",)).select("doc_id", "quality", "source", F.length("text").cast("long").alias("chars"))


@query("c3_merge_with_saved", f"WITH {RECORDS_SQL} SELECT model, condition, count(*) AS n, sum(CASE WHEN model = 'm1' AND condition = 'cot' THEN 1 ELSE 0 END)::BIGINT AS fresh FROM records GROUP BY ALL")
def _(spark, d):
    own = records(spark, d).select("model", "condition", "key")
    rerun = (F.col("model") == "m1") & (F.col("condition") == "cot")
    out = corpus.merged(own.withColumn("fresh", F.lit(0)), own.filter(rerun).withColumn("fresh", F.lit(1)))
    return out.groupBy("model", "condition").agg(F.count("*").alias("n"), F.sum("fresh").alias("fresh"))


@query("c4_top_up", "WITH have AS (SELECT doc_id, source FROM documents WHERE doc_id % 10 = 0), extra AS (SELECT doc_id, source FROM documents WHERE doc_id % 10 <> 0 ORDER BY source, doc_id LIMIT greatest(0, (SELECT count(*) * 15 // 100 FROM documents) - (SELECT count(*) FROM have))::BIGINT) SELECT * FROM have UNION ALL SELECT * FROM extra")
def _(spark, d):
    base = docs(spark, d).select("doc_id", "source")
    return corpus.topped_up(base.filter("doc_id % 10 = 0"), base, base.count() * 15 // 100, ["source", "doc_id"], ("doc_id", "source"))


@query("g2_id_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def _(spark, d):
    return docs(spark, d).select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("g3_except", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def _(spark, d):
    return docs(spark, d).select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("g1_union_all", f"WITH {RECORDS_SQL} SELECT condition, 2 * count(*) AS n FROM records GROUP BY condition")
def _(spark, d):
    one = records(spark, d).select("condition")
    return one.unionByName(one).groupBy("condition").agg(F.count("*").alias("n"))


@query("g4_distinct_sets", f"WITH {RECORDS_SQL}, p AS (SELECT unnest(preds).type AS label, model FROM records) SELECT label, array_to_string(list_sort(list_distinct(list(model))), ',') AS models FROM p GROUP BY label")
def _(spark, d):
    flat = records(spark, d).select("model", F.explode("preds").alias("p"))
    return flat.groupBy(F.col("p.type").alias("label")).agg(F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))


# ---- corpus statistics ----


@query("d4_benchmark_stats", f"""WITH {CORPUS_SQL}, b AS (SELECT source, len(types) AS g, len(list_filter({STRICT_SQL}, lambda t: t IS NOT NULL)) AS m, length(text) AS c,
  len(string_split(text, ' ')) AS w FROM corpus) SELECT source, count(*) AS n_samples, sum(g)::BIGINT AS total_pii, sum(m)::BIGINT AS total_canonical, round(avg(g), 6) AS mean_pii, quantile_cont(g::DOUBLE, 0.5) AS median_pii,
  round(avg(m), 6) AS mean_canonical, quantile_cont(m::DOUBLE, 0.5) AS median_canonical, round(avg(c), 6) AS mean_chars, quantile_cont(c::DOUBLE, 0.5) AS median_chars, round(avg(w), 6) AS mean_words, quantile_cont(w::DOUBLE, 0.5) AS median_words,
  round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct_of_total FROM b GROUP BY source""")
def _(spark, d):
    known = F.size(F.filter(corpus.mapped_types(F.col("types")), lambda t: t.isNotNull()))
    out = corpus.length_stats(typed(spark, d), "source", F.size("types"), known)
    return out.withColumns({c: r6(c) for c in out.columns if c.startswith(("mean", "pct"))})


@query("d5_benchmark_overview", f"WITH {RECORDS_SQL}, f AS (SELECT DISTINCT key, source, len(gold) AS g FROM records) SELECT source, count(*) AS n_samples, sum(g)::BIGINT AS total_pii, round(avg(g), 2) AS mean_pii FROM f GROUP BY source")
def _(spark, d):
    first = records(spark, d).select("key", "source", F.size("gold").alias("g")).dropDuplicates(["key"])
    return first.groupBy("source").agg(F.count("*").alias("n_samples"), F.sum("g").alias("total_pii"), F.round(F.avg("g"), 2).alias("mean_pii"))


@query("d6_type_distribution", f"WITH {CORPUS_SQL}, t AS (SELECT unnest({STRICT_SQL}) AS type FROM corpus) SELECT coalesce(type, 'TOTAL') AS type, count(*) AS n FROM t WHERE type IS NOT NULL GROUP BY ROLLUP (type)")
def _(spark, d):
    flat = typed(spark, d).select(F.explode(corpus.mapped_types(F.col("types"))).alias("type")).filter("type is not null")
    return flat.rollup("type").agg(F.count("*").alias("n")).select(F.coalesce("type", F.lit("TOTAL")).alias("type"), "n")


@query("d7_type_by_source", f"WITH {CORPUS_SQL}, t AS (SELECT source, unnest({STRICT_SQL}) AS type FROM corpus) SELECT type, count(*) FILTER (source = 'alpha') AS alpha, count(*) FILTER (source = 'beta') AS beta, count(*) FILTER (source = 'gamma') AS gamma FROM t WHERE type IS NOT NULL GROUP BY type")
def _(spark, d):
    flat = typed(spark, d).select("source", F.explode(corpus.mapped_types(F.col("types"))).alias("type")).filter("type is not null")
    return flat.groupBy("type").pivot("source", ["alpha", "beta", "gamma"]).count().na.fill(0)


_N = "coalesce(label, '') = ''"


@query("d8_gold_label_inventory", f"WITH {CORPUS_SQL}, t AS (SELECT unnest(types) AS label FROM corpus), k AS (SELECT label, {sql_key('label')} AS k FROM t) SELECT CASE WHEN {_N} THEN '(empty)' ELSE label END AS raw, k AS normalised, coalesce({sql_map('k', 'strict')}, '(unmapped)') AS mapped, count(*) AS n FROM k GROUP BY ALL")
def _(spark, d):
    flat = typed(spark, d).select(F.explode("types").alias("label"))
    out = flat.select(F.when(F.coalesce("label", F.lit("")) == "", "(empty)").otherwise(F.col("label")).alias("raw"), labels.key(F.col("label")).alias("normalised"), F.coalesce(labels.strict(F.col("label")), F.lit("(unmapped)")).alias("mapped"))
    return out.groupBy("raw", "normalised", "mapped").agg(F.count("*").alias("n"))


_KNOWN = ", ".join("'" + k.replace("'", "''") + "'" for k in labels.BEFORE)


@query("d9_prediction_label_inventory", f"WITH {RECORDS_SQL}, p AS (SELECT unnest(preds).type AS raw, model, condition FROM records) SELECT raw, {sql_key('raw')} AS normalised, {sql_key('raw')} IN ({_KNOWN}) AS in_map, count(*) AS n, array_to_string(list_sort(list_distinct(list(model))), ', ') AS models, array_to_string(list_sort(list_distinct(list(condition))), ', ') AS conditions FROM p GROUP BY ALL")
def _(spark, d):
    flat = records(spark, d).select("model", "condition", F.explode("preds").alias("p")).select("model", "condition", F.col("p.type").alias("raw"))
    k = labels.key(F.col("raw"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    return flat.groupBy("raw", k.alias("normalised"), k.isin(*labels.BEFORE).alias("in_map")).agg(F.count("*").alias("n"), joined("model").alias("models"), joined("condition").alias("conditions"))


@query("d10_unmapped_report", f"WITH {CORPUS_SQL}, t AS (SELECT source, unnest({_SK}) AS k FROM corpus) SELECT k AS source_label, count(*) AS n, array_to_string(list_sort(list_distinct(list(source))), ', ') AS sources FROM t WHERE k <> '' AND {sql_map('k', 'strict')} IS NULL GROUP BY k")
def _(spark, d):
    flat = typed(spark, d).select("source", F.explode("types").alias("t")).select("source", labels.key(F.col("t")).alias("source_label"), labels.strict(F.col("t")).alias("m"))
    return flat.filter("m is null and source_label <> ''").groupBy("source_label").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"))


@query("d13_pii_diagnostics", f"WITH {CORPUS_SQL} SELECT source, count(*) FILTER (len(types) = 0) AS without, count(*) FILTER (len(types) > 0) AS with_spans, round(100.0 * count(*) FILTER (len(types) > 0) / count(*), 6) AS pct_with, round(avg(len(types)), 6) AS mean_spans, max(len(types)) AS max_spans FROM corpus GROUP BY source")
def _(spark, d):
    n = F.size("types")
    return typed(spark, d).groupBy("source").agg(F.count_if(n == 0).alias("without"), F.count_if(n > 0).alias("with_spans"), r6(100 * F.count_if(n > 0) / F.count("*")).alias("pct_with"), r6(F.avg(n)).alias("mean_spans"), F.max(n).cast("long").alias("max_spans"))


@query("d14_sample_summary", f"WITH {CORPUS_SQL} SELECT source, min(length(text)) AS min_chars, max(length(text)) AS max_chars, round(avg(length(text)), 6) AS mean_chars, min(len(types)) AS min_spans, max(len(types)) AS max_spans, round(avg(len(types)), 6) AS mean_spans FROM corpus GROUP BY source")
def _(spark, d):
    base = typed(spark, d).select("source", F.length("text").cast("long").alias("chars"), F.size("types").cast("long").alias("spans"))
    return base.groupBy("source").agg(*[f(c).alias(f"{n}_{c}") if n != "mean" else r6(f(c)).alias(f"{n}_{c}") for c in ("chars", "spans") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])


@query("d26_uniqueness", f"WITH {CORPUS_SQL} SELECT count(*) AS n_rows, count(DISTINCT (source, original_index)) AS n_keys, count(*) = count(DISTINCT (source, original_index)) AS is_unique FROM corpus")
def _(spark, d):
    return corpus.unique(corpus_rows(spark, d), "source", "original_index")


@query("d37_describe", "SELECT count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars)::DOUBLE AS min, quantile_cont(n_chars::DOUBLE, 0.25) AS q25, quantile_cont(n_chars::DOUBLE, 0.5) AS q50, quantile_cont(n_chars::DOUBLE, 0.75) AS q75, max(n_chars)::DOUBLE AS max FROM documents")
def _(spark, d):
    q = F.percentile("n_chars", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    one = docs(spark, d).agg(F.count("n_chars").alias("n"), r6(F.avg("n_chars")).alias("mean"), r6(F.stddev_samp("n_chars")).alias("std"), F.min("n_chars").cast("double").alias("min"), q.alias("q"), F.max("n_chars").cast("double").alias("max"))
    return one.select("n", "mean", "std", "min", *[F.col("q")[i].alias(f"q{p}") for i, p in enumerate((25, 50, 75))], "max")


@query("f1_top_labels", f"WITH {RECORDS_SQL}, p AS (SELECT unnest(preds).type AS label FROM records) SELECT label, count(*) AS n FROM p GROUP BY label ORDER BY n DESC, label LIMIT 8")
def _(spark, d):
    flat = records(spark, d).select(F.explode("preds").alias("p")).select(F.col("p.type").alias("label"))
    return flat.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(8)


@query("b14_top_types", f"WITH {CORPUS_SQL}, t AS (SELECT source, unnest({_SK}) AS k FROM corpus), n AS (SELECT source, {sql_map('k', 'full')} AS type FROM t), top AS (SELECT type FROM n WHERE type <> 'UNKNOWN' GROUP BY type ORDER BY count(*) DESC, type LIMIT 3) SELECT source, type, count(*) AS n FROM n WHERE type IN (FROM top) GROUP BY ALL")
def _(spark, d):
    flat = typed(spark, d).select("source", F.explode("types").alias("t")).select("source", labels.symmetric(F.col("t")).alias("type")).filter("type <> 'UNKNOWN'")
    top = flat.groupBy("type").count().orderBy(F.desc("count"), "type").limit(3).select("type")
    return flat.join(F.broadcast(top), "type", "left_semi").groupBy("source", "type").agg(F.count("*").alias("n"))  # three rows

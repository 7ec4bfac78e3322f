"""Vector, lexical and card queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicon import LATIN as L
from ..operators import cards as K
from ..operators import lexical as B
from ..operators import vectors as V
from .base import query, table

IP = "list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def vectors(spark, sf):
    return table(spark, sf, "embeddings")


def probe(spark, sf, vec_id=0):
    """One stored vector as a query."""
    return [float(x) for x in vectors(spark, sf).where(F.col("vec_id") == vec_id).select("embedding").first()[0]]


@query(f"""
SELECT vec_id, round(score, 6) AS score, rank FROM (SELECT v.vec_id, {IP} AS score, row_number() OVER (ORDER BY {IP} DESC, v.vec_id)::INTEGER AS rank
FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE v.label IN (1, 2, 3) AND v.vec_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id < 20)) WHERE rank <= 10
""")
def search_filtered_topk(spark, sf):
    """VEC-03, FLT-09, SET-02, TOOL-01: the nearest under a hard filter, without those already shown."""
    e = vectors(spark, sf)
    return V.topk(e, probe(spark, sf), 10, allowed=e.where(F.col("label").isin(1, 2, 3)), avoid=e.where("vec_id < 20")).withColumn("score", F.round("score", 6))


@query(f"""
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, {IP} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({IP}, 12) DESC, v.vec_id)::INTEGER AS rank
FROM embeddings v, embeddings q WHERE v.vec_id <> q.vec_id) WHERE rank <= 5
""")
def similar_books(spark, sf):
    """VEC-04, VEC-28, TOOL-02: the nearest others of every vector."""
    e = vectors(spark, sf)
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    return V.topk_batch(q, e, 5, exclude_self=True).withColumn("score", F.round("score", 6))


SECTIONS = "s AS (SELECT label AS book, ['blurb', 'opening', 'titles', 'middle', 'ending', 'card'][(vec_id % 6) + 1] AS kind, vec_id AS ordinal, embedding FROM embeddings)"


def sections(spark, sf):
    kinds = F.array(*[F.lit(x) for x in ("blurb", "opening", "titles", "middle", "ending", "card")])
    return vectors(spark, sf).select(F.col("label").alias("book"), F.get(kinds, (F.col("vec_id") % 6).cast("int")).alias("kind"), F.col("vec_id").alias("ordinal"), "embedding")


_MAX = "SELECT book, round(max(score), 6) AS score, arg_max(kind, score) AS kind, arg_max(ordinal, score) AS ordinal FROM {} GROUP BY book ORDER BY max(score) DESC, book LIMIT 5"
_SC = f"sc AS (SELECT book, kind, ordinal, list_inner_product(s.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM s, (SELECT embedding FROM embeddings WHERE vec_id = 7) q)"


@query(f"WITH {SECTIONS}, {_SC} {_MAX.format('sc')}")
def maxpool_search(spark, sf):
    """VEC-06, VEC-07."""
    return V.maxpool(sections(spark, sf), probe(spark, sf, 7), 5, "book", "kind", "ordinal").withColumn("score", F.round("score", 6))


@query(f"WITH {SECTIONS}, {_SC}, cut AS (SELECT * FROM sc ORDER BY score DESC, book, kind, ordinal LIMIT 40) {_MAX.format('cut')}")
def maxpool_oversampled(spark, sf):
    """VEC-06 with its over-sampling cut."""
    return V.maxpool(sections(spark, sf), probe(spark, sf, 7), 5, "book", "kind", "ordinal", oversample=8).withColumn("score", F.round("score", 6))


def _pool_sql(w: str, n: str = "1") -> str:
    return f"""WITH {SECTIONS}, r AS (SELECT book, kind, embedding, ({w})::DOUBLE / {n} AS w FROM s), t AS (SELECT book, i, sum(w * embedding[i]::DOUBLE) / nullif(sum(w), 0) AS a, avg(embedding[i]::DOUBLE) AS p FROM r, range(1, 65) x(i) GROUP BY 1, 2),
m AS (SELECT book, i, coalesce(a, p) AS m FROM t) SELECT book, i::INTEGER AS dim, round(m / sqrt(sum(m * m) OVER (PARTITION BY book)), 6) AS value FROM m"""


def _dims(pooled):
    return pooled.select("book", F.posexplode("embedding").alias("dim", "value")).select("book", (F.col("dim") + 1).alias("dim"), F.round("value", 6).alias("value"))


@query(_pool_sql("1"))
def pool_mean(spark, sf):
    """VEC-13, plain."""
    return _dims(V.pool_books(sections(spark, sf), "book", "kind"))


@query(_pool_sql("CASE kind WHEN 'blurb' THEN 3 WHEN 'titles' THEN 3 WHEN 'middle' THEN 0.5 WHEN 'card' THEN 0 ELSE 1 END", "count(*) OVER (PARTITION BY book, kind)"))
def pool_kind_mean(spark, sf):
    """VEC-13 with weights by kind."""
    return _dims(V.pool_books(sections(spark, sf), "book", "kind", weights={"blurb": 3.0, "titles": 3.0, "middle": 0.5, "card": 0.0}, kind_mean=True))


@query(f"WITH {SECTIONS} SELECT kind, count(*) AS n, count(DISTINCT book) AS books FROM s GROUP BY 1")
def section_kind_counts(spark, sf):
    """AGG-16, SRC-37, SRC-38."""
    return sections(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("book").alias("books"))


@query(f"WITH {SECTIONS}, c AS (SELECT book, count(*) AS n FROM s WHERE kind <> 'card' GROUP BY 1) SELECT count(*) AS books, sum(n)::BIGINT AS sections, round(avg(n), 4) AS mean_sections, round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 4) AS single_share FROM c")
def section_stats(spark, sf):
    """AGG-15, VEC-09."""
    from ..operators.scoring import section_stats as stats

    return stats(sections(spark, sf).where("kind <> 'card'"), "book")


@query("SELECT label, count(*) AS n, count(*) FILTER (len(embedding) = 64 AND list_bool_and([isfinite(x) FOR x IN embedding])) AS valid FROM embeddings GROUP BY 1")
def validate_vectors(spark, sf):
    """VEC-17."""
    return vectors(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.count_if(V.valid("embedding", 64)).alias("valid"))


@query(f"WITH {SECTIONS}, k AS (SELECT s.book, s.ordinal, e.vec_id FROM s LEFT JOIN (SELECT vec_id FROM embeddings WHERE vec_id <> 33) e ON e.vec_id = s.ordinal) SELECT book, bool_and(vec_id IS NOT NULL) AS complete FROM k GROUP BY 1")
def vectors_complete(spark, sf):
    """JON-12, VEC-10."""
    s = sections(spark, sf)
    return V.all_or_nothing(s.select("book", "ordinal"), s.where("ordinal <> 33").select("ordinal"), "book", ["ordinal"])


TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
BM = f"""d AS (SELECT doc_id, {TOK} AS t FROM documents), n AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean FROM d),
p AS (SELECT doc_id, token, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(t) AS l, unnest(t) AS token FROM d) GROUP BY 1, 2),
f AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
a AS (SELECT item_id, unnest(list_distinct({TOK})) AS token FROM benchmark),
sc AS (SELECT item_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean))), 6) AS score FROM a JOIN f USING (token) JOIN p USING (token), n GROUP BY 1, 2),
bm AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc)"""


@query(f"WITH {BM} SELECT n_docs, round(mean, 6) AS mean_length, (SELECT count(*) FROM f) AS vocabulary, (SELECT count(*) FROM p) AS postings, (SELECT round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5))), 4) FROM f) AS idf_sum FROM n")
def bm25_index_stats(spark, sf):
    """VEC-18, VEC-19."""
    d = table(spark, sf, "documents")
    by_token, n_docs, mean = B.frequencies(B.token_lists(d, "doc_id", "text"))
    rows = by_token.agg(F.count("*").alias("vocabulary"), F.sum("df").alias("postings"), F.round(F.sum(B.idf(F.lit(n_docs), F.col("df"))), 4).alias("idf_sum"))
    return rows.select(F.lit(n_docs).cast("long").alias("n_docs"), F.round(F.lit(mean).cast("double"), 6).alias("mean_length"), "vocabulary", "postings", "idf_sum")


@query(f"WITH {BM} SELECT item_id, doc_id, score, rank::INTEGER AS rank FROM bm WHERE rank <= 10")
def bm25_topk(spark, sf):
    """VEC-20, VEC-23: all benchmark items against all documents."""
    return B.search(table(spark, sf, "benchmark"), table(spark, sf, "documents"), 10, "item_id", "text", "doc_id", "text")


@query(f"""WITH {BM}, u AS (SELECT doc_id, item_id, 1.0::DOUBLE / (60 + rank) AS part, '0' AS s FROM bm WHERE rank <= 20 UNION ALL
  SELECT doc_id, item_id, 2.0::DOUBLE / (60 + rank), '1' FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT item_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 3.0 / (tf + 2.0 * (0.6 + 0.4 * l / mean))), 6) AS score FROM a JOIN f USING (token) JOIN p USING (token), n GROUP BY 1, 2)) WHERE rank <= 20),
t AS (SELECT item_id, doc_id, round(sum(part), 9) AS score, string_agg(DISTINCT s, '+' ORDER BY s) AS sources FROM u GROUP BY 1, 2)
SELECT item_id, doc_id, score, sources, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM t) WHERE rank <= 10""")
def hybrid_topk(spark, sf):
    """WIN-04, VEC-24: two lexical rankings with other parameters, fused."""
    q, d = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    both = B.search_variants(q, d, 20, "item_id", "text", "doc_id", "text", [(1.5, 0.75), (2.0, 0.4)])
    return B.fuse_variants(both, ["item_id"], "doc_id", [1.0, 2.0]).where("rank <= 10")


CARDS = "c AS (SELECT p_partkey AS novel_id, p_type AS genre, p_brand AS subgenre, string_split(p_name, ' ') AS elements, [p_type] AS elements_unverified, CASE WHEN p_size < 17 THEN 'low' WHEN p_size < 34 THEN 'mid' ELSE 'high' END AS pace FROM part)"


def cards(spark, sf):
    p = table(spark, sf, "part")
    pace = F.when(F.col("p_size") < 17, "low").when(F.col("p_size") < 34, "mid").otherwise("high")
    return p.select(F.col("p_partkey").alias("novel_id"), F.col("p_type").alias("genre"), F.col("p_brand").alias("subgenre"), F.split("p_name", " ").alias("elements"), F.array("p_type").alias("elements_unverified"), F.create_map(F.lit("pace"), pace).alias("style"), F.col("p_retailprice").alias("price"))


def _word(spark, sf, column, n=0):
    p = table(spark, sf, "part")
    return p.select(F.split(column, " ")[n].alias("w")).agg(F.min("w")).first()[0]


@query(f"""WITH {CARDS}, w AS (SELECT min(elements[1]) AS e, min(genre) AS g, min(subgenre) AS s FROM c)
SELECT 'genre' AS filter, novel_id FROM c, w WHERE genre = g UNION ALL SELECT 'subgenre', novel_id FROM c, w WHERE subgenre = s
UNION ALL SELECT 'element', novel_id FROM c, w WHERE list_contains(list_concat(elements, elements_unverified), e) UNION ALL SELECT 'all', novel_id FROM c, w WHERE genre = g AND pace = 'low' UNION ALL SELECT 'none', novel_id FROM c""")
def card_filter(spark, sf):
    """FLT-08 to FLT-10."""
    c = cards(spark, sf)
    g, s, e = _word(spark, sf, "p_type"), c.agg(F.min("subgenre")).first()[0], _word(spark, sf, "p_name")
    g = c.agg(F.min("genre")).first()[0]
    f = {"genre": K.CardFilter(genre=g), "subgenre": K.CardFilter(g, s), "element": K.CardFilter(elements=(e,)), "all": K.CardFilter(genre=g, style=(("pace", "low"),)), "none": K.CardFilter()}
    out = None
    for name, spec in f.items():
        part = spec.select(c).select(F.lit(name).alias("filter"), "novel_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {CARDS}, r AS (SELECT 'genre' AS field, genre AS value FROM c UNION ALL SELECT 'subgenre', subgenre FROM c UNION ALL SELECT 'element', unnest(elements) FROM c UNION ALL SELECT 'style', 'pace=' || pace FROM c),
n AS (SELECT field, value, count(*) AS n FROM r GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value)::INTEGER AS place FROM n) WHERE place <= 50""")
def vocabulary_report(spark, sf):
    """AGG-14."""
    return K.vocabulary_report(cards(spark, sf))


@query(f"""WITH {CARDS}, b AS (SELECT novel_id, row_number() OVER (ORDER BY p_retailprice DESC, novel_id) AS rank FROM c JOIN part ON novel_id = p_partkey), w AS (SELECT min(elements[1]) AS e, min(genre) AS g, min(subgenre) AS s FROM c),
t AS (SELECT novel_id, rank, CASE WHEN subgenre = s THEN 0 WHEN genre = g THEN 1 ELSE 2 END::INTEGER AS tier, list_contains(elements, e)::INTEGER AS hits FROM b JOIN c USING (novel_id), w WHERE rank <= 50)
SELECT * FROM (SELECT novel_id, rank::INTEGER AS rank, tier, hits, row_number() OVER (ORDER BY tier, hits DESC, rank)::INTEGER AS new_rank FROM t) WHERE new_rank <= 10""")
def card_rerank(spark, sf):
    """WIN-05: five times over-sampled, in new order."""
    from pyspark.sql import Window

    c = cards(spark, sf)
    top = c.orderBy(F.desc("price"), "novel_id").limit(50)
    rows = top.select("novel_id", F.row_number().over(Window.orderBy(F.desc("price"), "novel_id")).alias("rank"))
    g, s, e = c.agg(F.min("genre"), F.min("subgenre"), F.min(F.col("elements")[0])).first()
    return K.card_rerank(rows, c, [g], [s], [e], 10)


@query(f"""WITH {CARDS}, w AS (SELECT min(elements[1]) AS e, min(genre) AS g FROM c) SELECT novel_id,
 CASE WHEN list_contains(elements, e) THEN 'yes' WHEN genre = g THEN 'yes' WHEN pace = 'high' THEN 'yes' ELSE 'no' END AS verdict, CASE WHEN list_contains(elements, e) THEN 'element' WHEN genre = g THEN 'genre' ELSE 'style' END AS source,
 genre || '·' || subgenre AS label, 'genre: ' || genre || chr(10) || 'subgenre: ' || subgenre AS card_text FROM c, w""")
def card_verdict(spark, sf):
    """FLT-14, FLT-28, JSN-16."""
    c = cards(spark, sf)
    g, e = c.agg(F.min("genre"), F.min(F.col("elements")[0])).first()
    v = K.card_verdict("fast", {"fast": {"element": e, "genre": g, "style": ("pace", "high")}})
    return c.select("novel_id", v["verdict"].alias("verdict"), v["source"].alias("source"), K.label().alias("label"), K.card_text(["genre", "subgenre"]).alias("card_text"))


_D = lambda f: f"(length(text) - length(replace(text, '{f}', '')))::DOUBLE / {len(f)} / length(text) * 100000.0"
_FORMS = sorted({f for v in L.term_forms.values() for f in v})
_MD = {t: "(" + " + ".join(_D(f) for f in v) + ")" for t, v in L.term_forms.items()}
_TRI = lambda e: f"CASE WHEN {e} >= 3.0 THEN true WHEN {e} <= 1.0 THEN false END"


def density_map(spark, sf):
    """SRC-16: one row per document with a map from form to density; a document without text has no map."""
    d = table(spark, sf, "documents")
    m = F.create_map(*[x for f in _FORMS for x in (F.lit(f), X.term_density("text", f))])
    return d.select("doc_id", F.when(F.char_length("text") > 0, m).alias("densities"))


@query(f"SELECT doc_id, {_TRI(f'greatest({_MD["robot"]}, {_MD["travel"]})')} AS violation, {_TRI(_MD['robot'])} AS robot, NULL::BOOLEAN AS unknown, " + " || ',' || ".join(f"'{t}=' || CASE WHEN {_MD[t]} >= 3 THEN 'violates' WHEN {_MD[t]} <= 1 THEN 'clean' ELSE 'unclear' END" for t in ("robot", "love")) + " AS flags FROM documents WHERE length(text) > 0")
def rule_verdict(spark, sf):
    """FLT-01 to FLT-04, FLT-07, AGG-13, UDF-11, TOOL-05."""
    d = density_map(spark, sf).where("densities is not null")
    return d.select(
        "doc_id", K.violation_by_terms("densities", ["robot", "travel", "other"], L).alias("violation"), K.violation_by_terms("densities", ["robot"], L).alias("robot"),
        K.violation_by_terms("densities", ["other"], L).alias("unknown"), F.array_join(K.density_flags("densities", ["robot", "love"], L), ",").alias("flags"),
    )


_FD = {t: _MD[t] for t in L.term_forms}


@query("WITH d AS (SELECT " + ", ".join(f"{e} AS {t}" for t, e in _FD.items()) + " FROM documents WHERE length(text) > 0), u AS (UNPIVOT d ON COLUMNS(*) INTO NAME term VALUE x) SELECT term, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.9), 6) AS p90, round(max(x), 6) AS most, round(avg((x >= 3)::INTEGER), 6) AS violating, round(avg((x <= 1)::INTEGER), 6) AS clean FROM u GROUP BY 1")
def density_summary(spark, sf):
    """AGG-26."""
    d = table(spark, sf, "documents").where(F.char_length("text") > 0)
    wide = d.select(*[X.merged_density("text", v).alias(t) for t, v in L.term_forms.items()])
    long = wide.unpivot([], list(L.term_forms), "term", "x")
    return long.groupBy("term").agg(
        F.round(F.percentile("x", 0.5), 6).alias("median"), F.round(F.percentile("x", 0.9), 6).alias("p90"), F.round(F.max("x"), 6).alias("most"),
        F.round(F.avg((F.col("x") >= 3).cast("int")), 6).alias("violating"), F.round(F.avg((F.col("x") <= 1).cast("int")), 6).alias("clean"),
    )


@query("""WITH t AS (SELECT item_id, [x FOR x IN list_concat(string_split(text, ' '), ['system', ' ', 'boring', 'love']) IF trim(x) <> ''] AS t FROM benchmark)
SELECT item_id, array_to_string([x FOR x IN t IF x IN ('system', 'travel', 'school', 'love', 'robot')], ',') AS in_text, array_to_string([x FOR x IN t IF x NOT IN ('system', 'travel', 'school', 'love', 'robot')], ',') AS meta FROM t""")
def split_negatives(spark, sf):
    """FLT-05, FLT-06."""
    b = table(spark, sf, "benchmark")
    s = K.split_negatives(F.concat(F.split("text", " "), F.array(*map(F.lit, ["system", " ", "boring", "love"]))), L)
    return b.select("item_id", F.array_join(s["in_text"], ",").alias("in_text"), F.array_join(s["meta"], ",").alias("meta"))


_VOC = K.Vocabulary(genres={"the": ("of", "and"), "in": ("to",)}, elements=("a", "is", "on"), subgenre_aliases={"for": "to", "the": "of"}, element_aliases={"are": "is"})


@query("""WITH t AS (SELECT item_id, string_split(lower(text), ' ') AS t FROM benchmark) SELECT item_id,
 array_to_string(list_sort(list_distinct([x FOR x IN t IF x IN ('the', 'in')])), ',') AS genres,
 array_to_string(list_sort(list_distinct(list_concat([x FOR x IN t IF x IN ('of', 'and', 'to')], ['to' FOR x IN t IF x = 'for']))), ',') AS subgenres,
 array_to_string(list_sort(list_distinct(list_concat([x FOR x IN t IF x IN ('a', 'is', 'on')], ['is' FOR x IN t IF x = 'are']))), ',') AS elements FROM t""")
def query_targets(spark, sf):
    """FLT-26, FLT-27."""
    q = K.query_targets(F.split(F.lower("text"), " "), _VOC)
    return table(spark, sf, "benchmark").select("item_id", *[F.array_join(F.array_sort(q[c]), ",").alias(c) for c in ("genres", "subgenres", "elements")])

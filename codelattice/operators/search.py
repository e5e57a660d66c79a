"""Lexical and fused search: BM25 over symbol words, trigram substrings, rank fusion, reranking, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codelattice.functions import text as T
from codelattice.operators import predicates as P
from codelattice.operators.current import SQL, current_nodes, whole_numbers
from codelattice.operators.lookup import _open
from codelattice.operators.text import SQL_TOKENS
from codelattice.operators.vectors import exact_search, static_embedding
from codelattice.plans.materialize import Workspace
from codelattice.sources.tables import table

K1, B, RRF, FETCH, LEAST_IDF = 1.2, 0.75, 60, 40, 1e-6
#: Results of a search; candidates that a list gives to the fusion; rows of each lexical branch for one of them.
K = 10
FAN, BRANCH = max(3 * K, 100), 4
#: Verbs of queries and the verbs that names begin with for the same.
VERBS = {
    "register": ("add", "install", "append",),
    "install": ("add", "register",),
    "attach": ("add", "append",),
    "remove": ("delete", "detach",),
    "delete": ("remove", "destroy",),
    "detach": ("remove", "detach",),
    "lookup": ("get", "find", "fetch", "resolve",),
    "retrieve": ("get", "fetch", "load", "read",),
    "fetch": ("get", "retrieve", "load",),
    "find": ("lookup", "resolve", "search",),
    "create": ("new", "make", "build",),
    "make": ("new", "create", "build",),
    "build": ("new", "make", "create",),
}


def rounded(c: Column, digits: int) -> Column:
    """A number that is not negative, rounded in double arithmetic: equal sums come out equal whatever their order, without decimals."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = FETCH, prefix: bool = False) -> DataFrame:
    """``(query_id, doc_id, score)``: BM25 of documents by query words, any of which may match.

    ``docs`` (doc_id, tokens), ``queries`` (query_id, tokens).  Only postings of words that
    some query has are kept before they are counted; hot words are pre-aggregated.  Ties by
    doc_id; ``k`` rows a query.  With ``prefix`` a query word of three bytes or more stands for
    all words that begin with it, counted as one word.  Documents and queries without words give no rows.
    """
    work = Workspace(docs.sparkSession, "bm25")
    numbered = work.write(docs.select("doc_id", "tokens").where(F.size("tokens") > 0).withColumn("nr", F.monotonically_increasing_id()), "docs")
    docs = numbered.select(F.col("nr").alias("doc_id"), "tokens")  # numbers instead of ids while there are many rows
    length = docs.select("doc_id", F.size("tokens").alias("len"))
    stats = length.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg")).first()
    n, avg_len = F.lit(stats["n"]), F.lit(stats["avg"] or 1.0)
    # queries of the same words are scored once
    same = queries.select(F.col("query_id").alias("asked_by"), F.array_join(F.array_sort(F.array_distinct("tokens")), " ").alias("words"))
    said = work.write(same.select("words").distinct().withColumn("query_id", F.monotonically_increasing_id()), "words")
    asked = said.select("query_id", F.explode(F.split("words", " ")).alias("term")).where("term <> ''")
    terms = asked.select("term").distinct()
    held = docs.select("doc_id", F.explode("tokens").alias("term"))
    if prefix:
        head = F.substring("word", 1, 3)
        words = held.select(F.col("term").alias("word")).distinct().withColumn("head", head)
        meant = words.join(terms.withColumn("head", F.substring("term", 1, 3)), "head").where((F.col("word") == F.col("term")) | (F.octet_length("term") >= 3) & F.startswith("word", "term"))
        held = held.select("doc_id", F.col("term").alias("word")).join(meant.select("word", "term"), "word")
    else:
        held = held.join(terms, "term", "left_semi")
    tf = held.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / avg_len))
    weighed = tf.join(df, "term").join(length, "doc_id").select("doc_id", "term", part.alias("part"))
    scored = weighed.join(asked, "term").groupBy("query_id", "doc_id").agg(rounded(F.sum("part"), 9).alias("score"))
    if k is not None:  # all that tie with the k-th learn their ids, which decide
        scored = scored.withColumn("r_", F.rank().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))).where(F.col("r_") <= k).drop("r_")
    named = scored.join(numbered.select(F.col("nr").alias("n_"), F.col("doc_id").alias("id_")), F.col("doc_id") == F.col("n_")).select("query_id", F.col("id_").alias("doc_id"), "score")
    best = top_k(named, k)
    return best.join(said, "query_id").drop("query_id").join(same, "words").select(F.col("asked_by").alias("query_id"), "doc_id", "score", "rank")


def top_k(scored: DataFrame, k: int | None) -> DataFrame:
    """The best k of each query by (score desc, doc_id), with their rank from 1."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def substring_hits(docs: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, doc_id): documents that hold the query as a substring, any case; with ``k`` the first ones of each phrase by id.

    Blocked by the query's rarest trigram, and only grams of queries are kept of the documents;
    the text is met once for each candidate.  Queries under three bytes match nothing.
    """
    q = queries.select("query_id", F.lower(F.regexp_replace("phrase", '"', "")).alias("phrase")).where(F.octet_length("phrase") >= 3)
    grams = lambda c: F.when(F.length(c) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(F.col(c), i, F.lit(3))))).otherwise(F.array(F.col(c)))
    phrases = q.select("phrase").distinct()
    wanted = phrases.select("phrase", F.explode(grams("phrase")).alias("gram"))
    low = docs.where("text IS NOT NULL").select("doc_id", F.lower("text").alias("low"))
    held = low.where(F.length("low") >= 3).select("doc_id", F.explode(grams("low")).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi")
    held = Workspace(docs.sparkSession, "substring").write(held, "grams")
    often = held.groupBy("gram").agg(F.count(F.lit(1)).alias("docs"))
    rarest = wanted.join(often, "gram", "left").groupBy("phrase").agg(F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    found = held.join(rarest, "gram").select("doc_id", "phrase").join(low, "doc_id").where(F.contains("low", "phrase")).select("doc_id", "phrase")
    short = phrases.where(F.length("phrase") < 3)  # three bytes, but fewer characters: no gram, so looked up by text
    some = short.isEmpty()
    if not some:
        few = [r["phrase"] for r in short.collect()]  # at most two characters each
        found = found.unionByName(low.select("doc_id", F.explode(F.filter(F.array(*map(F.lit, few)), lambda p: F.contains(F.col("low"), p))).alias("phrase")))
    found = found.distinct()
    if k is not None:
        found = found.withColumn("r_", F.row_number().over(Window.partitionBy("phrase").orderBy("doc_id"))).where(F.col("r_") <= k).drop("r_")
    return q.select("query_id", "phrase").distinct().join(found, "phrase").select("query_id", "doc_id")


def fuse(lists: list[DataFrame], base: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, doc_id, rank from 1)."""
    rows = lists[0].select("query_id", "doc_id", "rank")
    for x in lists[1:]:
        rows = rows.unionByName(x.select("query_id", "doc_id", "rank"))
    return rows.groupBy("query_id", "doc_id").agg(rounded(F.sum(F.lit(1.0) / (base + F.col("rank"))), 12).alias("score"))


def stems_of() -> Column:
    """Parts of a symbol's path and of its file's name."""
    return F.array_distinct(F.concat(T.identifier_parts(F.col("symbol_path")), T.identifier_parts(F.regexp_replace(P.basename(F.col("file_path")), r"\.[^.]*$", ""))))


def verb_of() -> Column:
    """The word that a symbol's own name begins with."""
    return F.try_element_at(T.identifier_parts(P.last_segment(F.col("symbol_path"))), F.lit(1))


def meant_by(tokens: Column) -> Column:
    """Verbs that names begin with for the verbs among a query's words."""
    alike = F.create_map(*[x for v, names in VERBS.items() for x in (F.lit(v), F.array(*map(F.lit, names)))])
    return F.array_distinct(F.flatten(F.filter(F.transform(tokens, lambda t: F.element_at(alike, t)), lambda x: x.isNotNull())))


def rerank(hits: DataFrame) -> DataFrame:
    """Bonuses for definitions, names that begin with a verb of the query's meaning, matching stems and files with several hits; demotions for noise paths and coarse kinds.

    ``hits`` (query_id, doc_id, score, tokens, symbol_path, kind, file_path; stems, verb and meant where they are known).
    """
    top = F.max("score").over(Window.partitionBy("query_id"))
    parted = {"stems": stems_of(), "verb": verb_of(), "meant": meant_by(F.col("tokens"))}
    hits = hits.withColumns({c: x for c, x in parted.items() if c not in hits.columns})
    name = F.lower(P.last_segment(F.col("symbol_path")))
    defined = F.array_contains("tokens", name) & F.col("kind").isin(*P.DEFINITION_KINDS)
    synonym = F.array_contains("meant", F.col("verb")) & F.col("kind").isin(*P.DEFINITION_KINDS)
    matched = F.size(F.filter("tokens", lambda t: F.array_contains(F.col("stems"), t)))
    in_file = F.count("file_path").over(Window.partitionBy("query_id", "file_path"))
    coherent = F.when(F.col("file_path").isNull(), 0).otherwise(F.least(in_file - 1, F.lit(4)))
    score = F.col("score") + F.col("top") * (F.coalesce(defined, F.lit(False)).cast("int") + F.coalesce(synonym, F.lit(False)).cast("int") + 0.25 * F.col("matched") + 0.05 * F.col("coherent"))
    score = score * F.when(P.is_noise_path(F.col("file_path")), 0.6).otherwise(1.0) * F.when(F.col("kind").isin("package", "file", "module"), 0.5).otherwise(1.0)
    h = hits.withColumn("top", top).withColumn("matched", matched).withColumn("coherent", coherent)
    return h.withColumn("score", rounded(score, 9)).drop("top", "stems", "verb", "meant", "matched", "coherent")


def tiers(hits: DataFrame) -> DataFrame:
    """Each hit's score against the best of its query: top, strong or weak; and min-max normalised."""
    w = Window.partitionBy("query_id")
    best, least = F.max("score").over(w), F.min("score").over(w)
    tier = F.when(best <= 0, "weak").when(F.col("score") >= 0.95 * best, "top").when(F.col("score") >= 0.8 * best, "strong").otherwise("weak")
    return hits.withColumn("tier", tier).withColumn("normal", F.round(F.when(best - least <= 0, 1.0).otherwise((F.col("score") - least) / (best - least)), 6))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    n = current_nodes(table(spark, d, "nodes")).where("branch = 'main'")
    return n.select(F.col("node_id").alias("doc_id"), T.symbol_tokens(F.concat_ws(" ", "kind", "symbol_path")).alias("tokens"), F.col("symbol_path").alias("text"), "symbol_path", "kind", "file_path")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """Messages of open findings, as search queries."""
    m = _open(spark, d).where("state = 'open' AND message IS NOT NULL").select("message").distinct()
    return m.select(F.col("message").alias("query_id"), T.query_tokens(F.substring_index("message", ": ", -1)).alias("tokens"), P.last_segment(F.regexp_replace("message", " ", ".")).alias("phrase"))


def lexical_words(spark: SparkSession, d: str) -> DataFrame:
    hits = bm25(*_inputs(spark, d), 10)
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def lexical_trigram(spark: SparkSession, d: str) -> DataFrame:
    hits = substring_hits(_docs(spark, d), _queries(spark, d))
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("doc_id").alias("first_doc"))


def nearest(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: the k documents nearest to each query by their embedded kind and symbol; queries of one text are searched once."""
    embed = static_embedding()
    dv = docs.select(F.xxhash64("doc_id").alias("vec_id"), "doc_id", embed(F.concat_ws(" ", "kind", "symbol_path")).alias("embedding"))
    dv = Workspace(docs.sparkSession, "nearest").write(dv, "vectors")  # embedded once, apart from the search
    asked = queries.select("query_id", F.substring_index("query_id", ": ", -1).alias("said"))
    texts = asked.select("said").distinct().select(F.xxhash64(F.lit("query"), "said").alias("vec_id"), "said")
    hits = exact_search(dv, texts.select("vec_id", embed("said").alias("embedding")), k).select(F.col("query_id").alias("q_"), F.col("vec_id").alias("d_"), "score", "rank")
    hits = hits.join(texts.select(F.col("vec_id").alias("q_"), "said"), "q_").join(dv.select(F.col("vec_id").alias("d_"), "doc_id"), "d_")
    return hits.join(asked, "said").select("query_id", "doc_id", "score", "rank")


def lexical(docs: DataFrame, queries: DataFrame, k: int = FAN) -> DataFrame:
    """Words (by their beginnings) and substrings fused, ranks counted from 0 as within a lexical index; ``BRANCH`` times k rows of each."""
    work = Workspace(docs.sparkSession, "lexical")
    same = queries.select("query_id", F.array_join(F.array_sort(F.array_distinct("tokens")), " ").alias("words"), F.coalesce("phrase", F.lit("")).alias("phrase"))
    # queries of the same words and phrase are searched once
    asked = work.write(same.select("words", "phrase").distinct().withColumn("nr", F.monotonically_increasing_id()), "asked")
    one = asked.select(F.col("nr").alias("query_id"), F.filter(F.split("words", " "), lambda w: w != "").alias("tokens"), "phrase")
    sub = substring_hits(docs, one, BRANCH * k).withColumn("score", F.lit(0.0))
    best = work.write(top_k(fuse([bm25(docs, one, BRANCH * k, prefix=True), top_k(sub, BRANCH * k)], RRF - 1), k), "best")
    return best.withColumnRenamed("query_id", "nr").join(asked, "nr").join(same, ["words", "phrase"]).select("query_id", "doc_id", "score", "rank")


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Words and substrings fused: what the lexical index gives to a search."""
    return lexical(*_inputs(spark, d)).select("query_id", "doc_id", "score", "rank")


def search_lexical(spark: SparkSession, d: str) -> DataFrame:
    """The search where no vectors can be made: the lexical list alone, reranked, cut to 10, with tiers, and why it is poorer."""
    docs, queries = _inputs(spark, d)
    hits = fuse([lexical(docs, queries)]).join(docs.drop("tokens", "text"), "doc_id").join(queries.select("query_id", "tokens", "meant"), "query_id")
    best = tiers(top_k(rerank(hits), K))
    return best.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank", "tier", "normal", F.lit("embedder unreachable").alias("degraded"))


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents and queries, worked out once."""
    work = Workspace(spark, "search")
    return work.write(_docs(spark, d).withColumns({"stems": stems_of(), "verb": verb_of()}), "docs"), work.write(_queries(spark, d).withColumn("meant", meant_by(F.col("tokens"))), "queries")


def search_reranked(spark: SparkSession, d: str) -> DataFrame:
    """The whole search: lexical and vector lists fused, hydrated, all candidates reranked, cut to 10, with tiers."""
    docs, queries = _inputs(spark, d)
    fused = fuse([lexical(docs, queries), nearest(docs, queries, FAN)])
    hits = fused.join(docs.drop("tokens", "text"), "doc_id").join(queries.select("query_id", "tokens", "meant"), "query_id")
    best = top_k(rerank(hits), K)
    return tiers(best).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank", "tier")


_CF = "cf AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY finding_id, branch ORDER BY created_at DESC NULLS LAST, state ASC NULLS FIRST, severity ASC NULLS FIRST) = 1)"
_SEARCH = rf"""WITH {SQL}, {_CF}, q AS (SELECT DISTINCT message AS query_id, regexp_extract(message, '([^ ]*)$', 1) AS phrase FROM cf WHERE state = 'open' AND message IS NOT NULL),
qt AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, regexp_replace(unnest(regexp_split_to_array(lower(regexp_replace(query_id, '^.*: ', '')), '\s+')), '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g') AS term FROM q) WHERE strlen(term) >= 3),
src AS (SELECT node_id || '|' || kind || ' ' || coalesce(symbol_path, '') AS s0, node_id, kind || ' ' || coalesce(symbol_path, '') AS s FROM cn WHERE branch = 'main'),
tok AS (SELECT * FROM {SQL_TOKENS.format(src='(SELECT DISTINCT s FROM src)')}),
tl AS (SELECT s, token, count(*) AS tf FROM tok GROUP BY 1, 2), ln AS (SELECT s, sum(tf) AS len FROM tl GROUP BY 1),
dl AS (SELECT node_id AS doc_id, len, s FROM src JOIN ln USING (s)), st AS (SELECT count(*) AS n, avg(len) AS al FROM dl),
tf AS (SELECT d.doc_id, t.token AS term, t.tf, d.len FROM dl d JOIN tl t USING (s)), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT query_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 9) AS score
 FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm),
mt AS (SELECT DISTINCT t.term, v.token FROM (SELECT DISTINCT term FROM qt) t JOIN (SELECT DISTINCT token FROM tl) v ON starts_with(v.token, t.term)),
ps AS (SELECT s, term, sum(tf) AS tf FROM tl JOIN mt USING (token) GROUP BY 1, 2), pf AS (SELECT d.doc_id, p.term, p.tf, d.len FROM dl d JOIN ps p USING (s)), pd AS (SELECT term, count(*) AS df FROM pf GROUP BY 1),
pm AS (SELECT query_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 9) AS score
 FROM qt JOIN pf USING (term) JOIN pd USING (term), st GROUP BY 1, 2),
pr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM pm QUALIFY rank <= 400),
sb AS (SELECT q.query_id, n.node_id AS doc_id, row_number() OVER (PARTITION BY q.query_id ORDER BY n.node_id) AS rank FROM q JOIN cn n ON n.branch = 'main' AND strlen(phrase) >= 3 AND contains(lower(n.symbol_path), lower(phrase))),
fu AS (SELECT query_id, doc_id, round(sum(1.0 / (59 + rank)), 12) AS score FROM (SELECT query_id, doc_id, rank FROM pr UNION ALL SELECT query_id, doc_id, rank FROM sb WHERE rank <= 400) GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fu QUALIFY rank <= 100)"""
_SPLIT = r"regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')"
QUERIES = {f.__name__: f for f in (lexical_words, lexical_trigram, rrf_fusion, search_lexical, search_reranked)}
ORACLE = {
    "lexical_words": _SEARCH + " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM br WHERE rank <= 10",
    "lexical_trigram": _SEARCH + " SELECT query_id, count(*) AS hits, min(doc_id) AS first_doc FROM sb GROUP BY 1",
    "search_lexical": _SEARCH
    + rf""", lx AS (SELECT query_id, doc_id, round(1.0 / (60 + rank), 12) AS score FROM fr), h AS (SELECT f.query_id, f.doc_id, f.score, n.symbol_path, n.kind, n.file_path, list_distinct(list_filter(string_split(lower(regexp_replace({_SPLIT.format(x="coalesce(n.symbol_path, '')")}, '[_./\-\s]+', ' ', 'g')) || ' ' ||
  lower(regexp_replace({_SPLIT.format(x="coalesce(regexp_replace(parse_filename(n.file_path), '[.][^.]*$', ''), '')")}, '[_./\-\s]+', ' ', 'g')), ' '), lambda x: x <> '')) AS stems, string_split(trim(lower(regexp_replace({_SPLIT.format(x="coalesce(split_part(n.symbol_path, '.', -1), '')")}, '[_./\-\s]+', ' ', 'g'))), ' ')[1] AS head FROM lx f JOIN cn n ON n.node_id = f.doc_id AND n.branch = 'main'),
ql AS (SELECT query_id, list_filter(list_transform(regexp_split_to_array(lower(regexp_replace(query_id, '^.*: ', '')), '\s+'), lambda x: regexp_replace(x, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')), lambda x: strlen(x) >= 3) AS tokens FROM q),
g AS (SELECT h.*, max(score) OVER (PARTITION BY h.query_id) AS top, CASE WHEN file_path IS NULL THEN 0 ELSE least(count(file_path) OVER (PARTITION BY h.query_id, file_path) - 1, 4) END AS coherent,
 coalesce((list_contains(tokens, lower(split_part(symbol_path, '.', -1))) AND kind IN ('function', 'method', 'type', 'struct', 'interface', 'class'))::INT, 0) AS defined,
 coalesce((len(list_filter(tokens, lambda t: list_contains(CASE t WHEN 'register' THEN ['add', 'install', 'append'] WHEN 'install' THEN ['add', 'register'] WHEN 'attach' THEN ['add', 'append'] WHEN 'remove' THEN ['delete', 'detach'] WHEN 'delete' THEN ['remove', 'destroy']
  WHEN 'detach' THEN ['remove', 'detach'] WHEN 'lookup' THEN ['get', 'find', 'fetch', 'resolve'] WHEN 'retrieve' THEN ['get', 'fetch', 'load', 'read'] WHEN 'fetch' THEN ['get', 'retrieve', 'load'] WHEN 'find' THEN ['lookup', 'resolve', 'search']
  WHEN 'create' THEN ['new', 'make', 'build'] WHEN 'make' THEN ['new', 'create', 'build'] WHEN 'build' THEN ['new', 'make', 'create'] END, head))) > 0 AND kind IN ('function', 'method', 'type', 'struct', 'interface', 'class'))::INT, 0) AS verb, len(list_filter(tokens, lambda x: list_contains(stems, x))) AS matched FROM h JOIN ql ON ql.query_id = h.query_id),
s AS (SELECT query_id, doc_id, round((score + top * (defined + verb + 0.25::DOUBLE * matched + 0.05::DOUBLE * coherent)) * CASE WHEN coalesce(ends_with(lower(file_path), '_test.go') OR ends_with(lower(file_path), '.d.ts') OR contains(lower(file_path), '/legacy/') OR contains(lower(file_path), '/examples/') OR contains(lower(file_path), '/vendor/') OR contains(lower(file_path), '/testdata/'), false) THEN 0.6::DOUBLE ELSE 1 END * CASE WHEN kind IN ('package', 'file', 'module') THEN 0.5::DOUBLE ELSE 1 END, 9) AS score FROM g),
k AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM s QUALIFY rank <= 10), b AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM k)
SELECT query_id, doc_id, round(score, 6) AS score, rank, CASE WHEN best <= 0 THEN 'weak' WHEN score >= 0.95::DOUBLE * best THEN 'top' WHEN score >= 0.8::DOUBLE * best THEN 'strong' ELSE 'weak' END AS tier,
 round(CASE WHEN best - min(score) OVER (PARTITION BY query_id) <= 0 THEN 1.0::DOUBLE ELSE (score - min(score) OVER (PARTITION BY query_id)) / (best - min(score) OVER (PARTITION BY query_id)) END, 6) AS normal, 'embedder unreachable' AS degraded FROM b""",
    "rrf_fusion": _SEARCH + " SELECT query_id, doc_id, score, rank FROM fr",
}
ORACLE["lexical_words"] = whole_numbers(ORACLE["lexical_words"], "rank")
ORACLE["rrf_fusion"] = whole_numbers(ORACLE["rrf_fusion"], "rank")

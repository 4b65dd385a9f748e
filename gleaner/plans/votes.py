"""Votes, link relevance, frontier, metrics. Predictions are pseudo-random numbers from md5, which both engines repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import frontier as P
from ..operators import links as L
from ..operators import votes as V
from ..functions import text as T
from ..functions import urls as U
from ..session import table
from ..operators.models import agreement
from . import query
from .corpus import _WORDS
from .pages import _TOK, _links_sql


def pseudo(salt: str, *cols: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), *(F.col(c).cast("string") for c in cols))), 1, 4), 16, 10).cast("int") / 65535


def _p(salt: str, *cols: str) -> str:
    return f"(('0x' || substr(md5('{salt}' || {' || '.join(cols)}), 1, 4))::INTEGER / 65535.0::DOUBLE)"


def label(salt: str, *cols: str) -> Column:
    return F.when(pseudo(salt, *cols) < 0.5, "0").otherwise("1")


def _l(salt: str, *cols: str) -> str:
    return f"(CASE WHEN {_p(salt, *cols)} < 0.5 THEN '0' ELSE '1' END)"


_PRED = f"pr AS (SELECT doc_id, quality AS truth, CASE WHEN {_p('q', 'doc_id')} < 0.8 THEN quality WHEN {_p('q', 'doc_id')} < 0.97 THEN 1 - quality ELSE 2 END AS predicted, {_p('v', 'doc_id')} * 2 - 1 AS value FROM labels)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = pseudo("q", "doc_id")
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("truth"), F.when(q < 0.8, F.col("quality")).when(q < 0.97, 1 - F.col("quality")).otherwise(2).alias("predicted"), (pseudo("v", "doc_id") * 2 - 1).alias("value"))


@query(f"WITH {_PRED} SELECT round(avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM pr")
def accuracy_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.accuracy(predictions(spark, sf_dir)).select(F.round("accuracy", 9).alias("accuracy"))


_BY = f"{_PRED}, a AS (SELECT truth AS label, count(*) AS n_true, count(*) FILTER (truth = predicted) AS hit FROM pr GROUP BY truth), b AS (SELECT predicted AS label, count(*) AS n_predicted FROM pr GROUP BY predicted), m AS (SELECT coalesce(a.label, b.label) AS label, coalesce(hit, 0) AS hit, coalesce(n_predicted, 0) AS n_predicted, coalesce(n_true, 0) AS n_true FROM a FULL JOIN b ON a.label = b.label)"


@query(f"WITH {_BY} SELECT label, hit, n_predicted, n_true, round(coalesce(hit / nullif(n_predicted, 0), 0), 9) AS precision, round(coalesce(hit / nullif(n_true, 0), 0), 9) AS recall FROM m")
def precision_recall_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.by_label(predictions(spark, sf_dir)).withColumns({"precision": F.round("precision", 9), "recall": F.round("recall", 9)})


@query(f"WITH {_BY} SELECT label, printf('%.2f%%', round(coalesce(hit / nullif(n_predicted, 0), 0) * 100, 2)) AS precision, printf('%.2f%%', round(coalesce(hit / nullif(n_true, 0), 0) * 100, 2)) AS recall FROM m")
def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.report(E.by_label(predictions(spark, sf_dir)))


@query(f"WITH {_PRED}, a AS (SELECT truth, count(*) AS n, count(*) FILTER (truth = predicted) AS hit FROM pr GROUP BY truth) SELECT round(sum(hit) / sum(n), 9) AS micro, round(avg(hit / n), 9) AS macro FROM a")
def micro_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.micro_macro(predictions(spark, sf_dir)).select(F.round("micro", 9).alias("micro"), F.round("macro", 9).alias("macro"))


@query(f"WITH {_PRED}, c AS (SELECT count(*) FILTER (truth = 1 AND value >= 0) AS tp, count(*) FILTER (value >= 0) AS pp, count(*) FILTER (truth = 1) AS pos FROM pr) SELECT round(tp / pp, 9) AS precision, round(tp / pos, 9) AS recall, round(2 * (tp / pp) * (tp / pos) / (tp / pp + tp / pos), 9) AS f_score FROM c")
def fscore_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.f_score(predictions(spark, sf_dir)).select(*(F.round(c, 9).alias(c) for c in ("precision", "recall", "f_score")))


@query(f"WITH {_PRED} SELECT round(100 * avg(CASE WHEN truth = value THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(power(value - truth, 2)), 9) AS mse, round(power(corr(truth, value), 2), 9) AS r2 FROM pr")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.regression(predictions(spark, sf_dir)).select(F.round("accuracy", 6).alias("accuracy"), F.round("mse", 9).alias("mse"), F.round("r2", 9).alias("r2"))


@query("WITH k AS (SELECT event_type, value FROM events WHERE value > 0.01) SELECT event_type, round(CASE WHEN count(*) > 2 THEN (sum(value) - min(value) - max(value)) / (count(*) - 2) END, 6) AS mean, count(*) AS n FROM k GROUP BY event_type")
def trimmed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.trimmed_mean(table(spark, sf_dir, "events"), "event_type", "value").select("event_type", F.round("mean", 6).alias("mean"), "n")


@query("SELECT 'page' || page_id AS name, length(url) AS gold, length(html) AS candidate FROM pages")
def gold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("name", F.concat(F.lit("page"), F.col("page_id").cast("string")))
    gold = p.select("name", F.length("url").cast("long").alias("gold"))
    return E.paired(p.select(F.concat(F.lit("C_"), "name").alias("name"), F.length("html").cast("long").alias("candidate")), gold)


@query(f"WITH {_PRED}, t AS (SELECT doc_id, truth FROM pr), q AS (SELECT doc_id, predicted FROM pr) SELECT t.doc_id, truth, predicted FROM t JOIN q ON t.doc_id = q.doc_id")
def align_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return E.aligned(p.select("doc_id", "truth"), p.select("doc_id", "predicted"), "doc_id")


@query(f"WITH w AS (SELECT doc_id, list_distinct({_WORDS}) AS c, list_distinct({_WORDS.replace('text', 'left(text, length(text) // 2)')}) AS g FROM documents), i AS (SELECT doc_id, len(list_intersect(c, g)) AS n, len(c) AS c, len(g) AS g FROM w) SELECT doc_id, round(coalesce(n / nullif(c, 0), 0), 9) AS p, round(coalesce(n / nullif(g, 0), 0), 9) AS r, round(coalesce(n / nullif(c + g - n, 0), 0), 9) AS score FROM i")
def bag_overlap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("candidate"), T.words(F.expr("left(text, length(text) div 2)")).alias("gold"))
    return E.overlap_score(d).select("doc_id", *(F.round(c, 9).alias(c) for c in ("p", "r", "score")))


@query("WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) SELECT doc_id, pos, md5(l) AS left, md5(replace(l, 'e', 'E')) AS right FROM a")
def aligned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    j = E.lines_aligned(d, d.withColumn("text", F.replace("text", F.lit("e"), F.lit("E"))), "doc_id")
    return j.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5(F.col("left").cast("binary")).alias("left"), F.md5(F.col("right").cast("binary")).alias("right"))


_PAIRS6 = ", ".join(f"{_p(f'o{k}', 'doc_id')} - 0.5" for k in range(6))


@query(f"WITH d AS (SELECT doc_id, [{_PAIRS6}] AS v FROM labels), x AS (SELECT doc_id, unnest([0, 0, 0, 1, 1, 2]) AS i, unnest([1, 2, 3, 2, 3, 3]) AS j, unnest(v) AS v FROM d), w AS (SELECT doc_id, CASE WHEN v > 0 THEN i ELSE j END AS class, abs(v) AS m FROM x), e AS (SELECT doc_id, class, count(*) AS k, sum(m) AS s FROM w GROUP BY doc_id, class) SELECT doc_id, class AS winner, round(s / (2 * k) + k / 6, 9) AS score FROM e QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, class) = 1")
def ovo_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.array(*(pseudo(f"o{k}", "doc_id") - 0.5 for k in range(6))).alias("vals"))
    return V.one_vs_one(d).select(F.col("id").alias("doc_id"), "winner", F.round("score", 9).alias("score"))


_F = ("title", "headlines", "meta", "para")
_W = {"title": 3, "headlines": 2, "meta": 2, "para": 1}
_TEXT = {"title": "lang", "headlines": "source", "meta": "text", "para": "text"}
_VOTES = " + ".join(f"CASE WHEN length({_TEXT[f]}) > 2 AND {_p(f + 'p', 'doc_id')} >= 0.7 THEN (CASE WHEN {_l(f, 'doc_id')} = '0' THEN 1 ELSE -1 END) * {_W[f]} ELSE 0 END" for f in _F)
_TOP = ", ".join(f"CASE WHEN length({_TEXT[f]}) > 2 AND {_l(f, 'doc_id')} = tl THEN {_p(f + 'p', 'doc_id')} ELSE 0.0 END" for f in _F)


@query(f"WITH a AS (SELECT *, CASE WHEN {_VOTES} >= 0 THEN '0' ELSE '1' END AS tl, {_l('u', 'doc_id')} AS ul, {_p('up', 'doc_id')} AS up FROM documents), b AS (SELECT doc_id, tl, ul, up, greatest({_TOP}) AS tp FROM a) SELECT doc_id, CASE WHEN tl = ul OR tp >= up THEN tl ELSE ul END AS label, round(greatest(tp, up), 9) AS prob FROM b")
def document_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {f: (F.col(_TEXT[f]), label(f, "doc_id"), pseudo(f + "p", "doc_id")) for f in _F}
    y, p = V.document(fields, label("u", "doc_id"), pseudo("up", "doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", y.alias("label"), F.round(p, 9).alias("prob"))


_FIVE = " UNION ALL ".join(f"SELECT doc_id, {_l(f'y{k}', 'doc_id')} AS label, {_p(f'p{k}', 'doc_id')} AS prob FROM documents" for k in range(5))


@query(f"WITH v AS ({_FIVE}), e AS (SELECT doc_id, label, count(*) AS n, max(prob) AS prob FROM v WHERE prob >= 0.5 GROUP BY doc_id, label), t AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, prob DESC, label) = 1) SELECT d.doc_id, label, round(prob, 9) AS prob FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id")
def page_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = F.array(*(F.struct(label(f"y{k}", "doc_id").alias("label"), pseudo(f"p{k}", "doc_id").alias("prob")) for k in range(5)))
    d = table(spark, sf_dir, "documents").select("doc_id", V.majority(votes).alias("v"))
    return d.select("doc_id", "v.label", F.round("v.prob", 9).alias("prob"))


@query(f"SELECT doc_id, CASE WHEN ul <> tl AND up > tp AND tp < 0.9 THEN ul ELSE tl END AS label FROM (SELECT doc_id, {_l('u', 'doc_id')} AS ul, {_p('up', 'doc_id')} AS up, {_l('t', 'doc_id')} AS tl, {_p('tp', 'doc_id')} AS tp FROM documents)")
def url_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", V.url_and_text(label("u", "doc_id"), pseudo("up", "doc_id"), label("t", "doc_id"), pseudo("tp", "doc_id")).alias("label"))


@query(f"SELECT doc_id, CASE WHEN (p1 >= 0.5) = (p2 >= 0.5) THEN (p1 >= 0.5)::INTEGER WHEN p1 + p2 > 1 THEN 1 WHEN p1 + p2 < 1 THEN 0 ELSE ascii(md5(doc_id::VARCHAR)) % 2 END AS label, round((p1 + p2) / 2, 9) AS prob FROM (SELECT doc_id, {_p('1', 'doc_id')} AS p1, {_p('2', 'doc_id')} AS p2 FROM documents)")
def cotrain_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    p1, p2 = pseudo("1", "doc_id"), pseudo("2", "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", V.two_views(p1, p2, F.col("doc_id")).alias("label"), F.round(agreement(p1, p2), 9).alias("prob"))


@query("SELECT doc_id, unnest(['para', 'meta', 'title_meta1_para', 'title_meta2_para', 'title_meta3_para']) AS variant, md5(unnest([text, source, lang || ' ' || source || ' ' || text, lang || ' ' || source || ' ' || source || ' ' || text, lang || ' ' || source || ' ' || source || ' ' || source || ' ' || text])) AS digest FROM documents")
def field_weight_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("title"), F.col("source").alias("meta"), F.col("text").alias("para"))
    return V.field_variants(d).select("doc_id", "variant", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"WITH {_links_sql()} SELECT page_id, url, CASE WHEN length(anchor) < 2 THEN '0' WHEN list_has_any(string_split_regex(lower(anchor), '\\W+'), ['the', 'and', 'est']) THEN '0' ELSE 'model' END AS anchor_label, CASE WHEN length(anchor) < 2 THEN 0.0 WHEN list_has_any(string_split_regex(lower(anchor), '\\W+'), ['the', 'and', 'est']) THEN 1.0 ELSE -1.0 END::DOUBLE AS anchor_prob, CASE WHEN length(anchor) < 10 THEN '0' ELSE 'model' END AS para_label, CASE WHEN list_has_any({_TOK}, ['en', 'page']) THEN '1' WHEN list_has_any({_TOK}, ['the', 'fr']) THEN '0' ELSE 'model' END AS url_label FROM links")
def keyword_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, a = L.extract(table(spark, sf_dir, "pages")), F.col("anchor_text")
    r = links.select("page_id", "url", V.anchor_rule(a, ("the", "and", "est")).alias("a"), V.para_rule(a).alias("p"), V.url_rule(U.tokens(F.col("url")), ("the", "fr"), ("en", "page")).alias("u"))
    or_model = lambda c: F.coalesce(c, F.lit("model"))
    return r.select("page_id", "url", or_model(F.col("a.label")).alias("anchor_label"), F.coalesce("a.prob", F.lit(-1.0)).alias("anchor_prob"), or_model(F.col("p.label")).alias("para_label"), or_model(F.col("u.label")).alias("url_label"))


_REL = f"{_links_sql()}, rl AS (SELECT page_id, base AS parent_url, url, {_p('w', 'page_id')} AS node_weight, {_l('u', 'url')} AS ul, {_p('up', 'url')} AS up, {_l('a', 'anchor', 'url')} AS al, {_p('ap', 'anchor', 'url')} AS ap FROM links), rv AS (SELECT page_id, parent_url, url, node_weight, CASE WHEN up < 0.5 AND ap < 0.5 THEN NULL WHEN up < 0.5 THEN al WHEN ap < 0.5 THEN ul WHEN ul = al THEN ul WHEN up > ap OR (up = ap AND ul < al) THEN ul ELSE al END AS label, CASE WHEN up < 0.5 AND ap < 0.5 THEN NULL ELSE greatest(up, ap) END AS prob FROM rl), ok AS (SELECT * FROM rv WHERE label IS NOT NULL)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = L.extract(table(spark, sf_dir, "pages")).withColumnRenamed("anchor_text", "anchor")
    r = links.select("page_id", "parent_url", "url", pseudo("w", "page_id").alias("node_weight"), P.relevance(label("u", "url"), pseudo("up", "url"), label("a", "anchor", "url"), pseudo("ap", "anchor", "url")).alias("v"))
    return r.where("v is not null").select("page_id", "parent_url", "url", "node_weight", "v.label", "v.prob")


@query(f"WITH {_REL} SELECT page_id, url, label, round(prob, 9) AS prob FROM ok")
def link_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("page_id", "url", "label", F.round("prob", 9).alias("prob"))


_UP = f"{_REL}, pa AS (SELECT url, parent_url, max(node_weight) AS w FROM ok GROUP BY url, parent_url), be AS (SELECT url, label, prob FROM ok QUALIFY row_number() OVER (PARTITION BY url ORDER BY prob DESC, label) = 1), up AS (SELECT pa.url, count(*) AS n_parents, avg(w) AS mean_weight, any_value(prob) AS prob, any_value(label) AS label FROM pa JOIN be ON pa.url = be.url GROUP BY pa.url)"


@query(f"WITH {_UP} SELECT url, n_parents, round(mean_weight, 9) AS mean_weight, round(prob, 9) AS prob, label FROM up")
def link_graph_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.upsert(scored(spark, sf_dir)).select("url", "n_parents", F.round("mean_weight", 9).alias("mean_weight"), F.round("prob", 9).alias("prob"), "label")


@query(f"WITH {_UP} SELECT url, round(0.25 * mean_weight + 0.75 * prob, 9) AS priority FROM up")
def link_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.upsert(scored(spark, sf_dir)).select("url", F.round(P.priority(F.col("mean_weight"), F.col("prob")), 9).alias("priority"))


_LEV = f"{_UP}, lev AS (SELECT url, CASE WHEN prob >= 0.8 THEN 0 ELSE 1 END AS level, round(0.25 * mean_weight + 0.75 * prob, 9) AS priority FROM up WHERE label = '0' AND prob >= 0.5)"


@query(f"WITH {_LEV} SELECT url, level, priority FROM lev")
def frontier_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.levels(P.upsert(scored(spark, sf_dir))).select("url", "level", F.round("priority", 9).alias("priority"))


@query(f"WITH {_LEV} SELECT url, level, priority, round(priority * 1000, 6) AS request FROM lev ORDER BY level, priority DESC, url LIMIT 50")
def next_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.next_urls(frontier_levels(spark, sf_dir), 50)

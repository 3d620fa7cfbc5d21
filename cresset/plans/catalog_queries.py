"""Queries of the core operators over the test tables, and the SQL they are held against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cresset.functions import similarity, text
from cresset.operators import catalog, judging, retrieval
from cresset.plans import audit_queries, reference_queries, score_queries
from cresset.plans.sql import KIND, SPACES, common_sql, fold_sql, forms_sql, most_common_sql, normal_sql, ratio_sql, set_sql, short_sql, sort_sql, token_set_parts, token_set_sql, year_sql
from cresset.sources.tables import table
from cresset.sources.workspace import written

KINDS = {"movielens": "film", "yelp": "place"}
LEAST_ROWS, N_AUDIT, N_CALIBRATION = 12, 20, 30


def kind_of(scope: Column) -> Column:
    """The kind of title a catalog holds."""
    return reduce(lambda out, k: out.when(scope == k, KINDS[k]), KINDS, F.when(F.lit(False), "")).otherwise("product")


def catalog_popularity_quartile(spark: SparkSession, folder: str) -> DataFrame:
    built = catalog.build_catalog(table(spark, folder, "catalog", "row_id", "catalog", "item_id", "title"), table(spark, folder, "interactions", "catalog", "item_id"))
    return built.select("catalog", "item_id", "interaction_count", "popularity_quartile")


def eligible_users(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.eligible_users(table(spark, folder, "interactions", "user_id"), LEAST_ROWS)


def _hashed_user() -> Column:
    return F.pmod(F.substring("user_id", 2, 20).try_cast("long") * 2654435761, F.lit(4294967296))


def _split(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.split_users(eligible_users(spark, folder), N_AUDIT, N_CALIBRATION, _hashed_user())


def user_split(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder)


def _histories(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "interactions", "catalog", "user_id", "item_id", "timestamp")
    in_seconds = F.when(F.col("catalog") == "amazon", F.col("timestamp") / 1000).otherwise(F.col("timestamp").cast("double"))
    keyed = rows.select("user_id", F.concat_ws(":", "catalog", "item_id").alias("item_id"), in_seconds.alias("timestamp"))
    return catalog.ordered_histories(keyed, _split(spark, folder))


def user_histories(spark: SparkSession, folder: str) -> DataFrame:
    """Each sampled user's items in order of time, the last being held out."""
    return _histories(spark, folder)


def holdout_users(spark: SparkSession, folder: str) -> DataFrame:
    items = catalog_popularity_quartile(spark, folder).select(F.concat_ws(":", "catalog", "item_id").alias("item_id"), "popularity_quartile")
    return catalog.with_target_quartile(_histories(spark, folder), items)


def holdout_arrays(spark: SparkSession, folder: str) -> DataFrame:
    arrays = catalog.as_arrays(_histories(spark, folder))
    return arrays.select("user_id", F.array_join("history", " ").alias("history"), "target_item_id")


def normalized_titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "catalog", "row_id", "title").select("row_id", text.normalized("title").alias("normalized"))


def token_sortkey(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "catalog", "row_id", "normalized_title").select("row_id", text.sort_key("normalized_title").alias("sort_key"))


def title_year(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "verdicts", "row_id", "title").select("row_id", text.year_of("title").alias("year"))


def folded_titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "catalog", "row_id", "title").select("row_id", text.folded("title").alias("folded"))


def surface_forms(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "catalog", "row_id", "catalog", "title")
    return text.with_forms(rows, "title", kind_of(F.col("catalog"))).select("row_id", "form").distinct()


def _matched(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "verdicts", "row_id", "catalog", "title", "match_title")
    return rows.where("title is not null and match_title <> ''")


def short_title_guard(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _matched(spark, folder).select("row_id", text.normalized("title").alias("q"), text.normalized("match_title").alias("f"))
    return pairs.select("row_id", text.short_conflict("q", "f").alias("conflict"), text.tokens_agree("q", "f").alias("agree"))


def title_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """Ratios of matched verdicts' titles: of characters, sorted tokens, token sets, and over surface forms."""
    rows = _matched(spark, folder)
    pairs = rows.select("row_id", text.folded("title").alias("q"), text.folded("match_title").alias("f"))
    compared = {"indel": similarity.indel("q", "f"), "token_sort": similarity.token_sort("q", "f"), "token_set": similarity.token_set("q", "f")}
    ratios = pairs.select("row_id", *(F.round(c, 6).alias(n) for n, c in compared.items()))
    from cresset.operators.scoring import pair_scores

    forms = pair_scores(rows.select("row_id", F.col("title").alias("query"), F.col("match_title").alias("title"), kind_of(F.col("catalog")).alias("kind")), ["row_id"])
    return ratios.join(forms.select("row_id", F.round("score", 6).alias("score")), "row_id")


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.index(table(spark, folder, "catalog", "catalog", "item_id", "title"))


def _normal_entries(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "catalog", "catalog", "item_id", "normalized_title")
    return rows.select("catalog", "item_id", F.col("normalized_title").alias("folded")).where("folded <> ''").distinct()


def token_idf(spark: SparkSession, folder: str) -> DataFrame:
    weights = retrieval.token_weights(_normal_entries(spark, folder))
    return weights.select("catalog", "token", "df", F.round("idf", 6).alias("idf"))


def _queries(spark: SparkSession, folder: str) -> DataFrame:
    titles = table(spark, folder, "human_labels_201", "catalog", "generated_title").where("generated_title is not null").distinct()
    return titles.select(F.concat_ws("|", "catalog", "generated_title").alias("query"), "catalog", text.normalized("generated_title").alias("folded")).where("folded <> ''")


def rare_token_topk(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.by_rare_tokens(_queries(spark, folder), _normal_entries(spark, folder)).select("query", "item_id", "score")


def fuzzy_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The most similar entries of every labeled title, all pairs of its catalog."""
    queries = _queries(spark, folder).withColumn("sorted", text.sort_key("folded"))
    best = retrieval.compare_all(queries, _entries(spark, folder), retrieval.DEPTH.k)
    return best.select("query", "item_id", F.round("score", 6).alias("score"), "place")


def full_catalog_best(spark: SparkSession, folder: str) -> DataFrame:
    """Whether any entry of the whole catalog matches a labeled title at the cutoff, by token sets and by sorted tokens."""
    queries = written(_queries(spark, folder).withColumn("sorted", text.sort_key("folded")), "full-queries")
    entries = written(_entries(spark, folder), "full-entries")
    equal = queries.join(entries.select("catalog", "sorted").distinct(), ["catalog", "sorted"], "left_semi").select("query")
    rest = written(queries.join(equal, "query", "left_anti"), "full-unequal")
    out = queries.select("query").distinct()
    for scorer in ("token_set", "token_sort"):
        found = retrieval.compare_all(rest, entries, 1, retrieval.DEPTH.cutoff, scorer).select("query").union(equal)
        best = found.distinct().withColumn(scorer, F.lit(True))
        out = out.join(best, "query", "left").withColumn(scorer, F.coalesce(scorer, F.lit(False)))
    return out


def retrieved_candidates(spark: SparkSession, folder: str) -> DataFrame:
    titles = table(spark, folder, "human_labels_201", "catalog", "generated_title")
    return retrieval.retrieve(titles, table(spark, folder, "catalog", "catalog", "item_id", "title"), title="generated_title")


def label_items(spark: SparkSession, folder: str) -> DataFrame:
    names = [f"cand_{k}" for k in range(1, 9)]
    ids = [f"{n}_id" for n in names]
    rows = table(spark, folder, "human_labels_201", "row_id", "catalog", "generated_title", "llm_pick", *names, *ids)
    slots = F.filter(F.array(*(F.struct(F.col(n).alias("title"), F.col(i).alias("item_id")) for n, i in zip(names, ids))), lambda c: c["title"].isNotNull() & (c["title"] != ""))
    return rows.select("row_id", "catalog", F.coalesce("generated_title", F.lit("")).alias("title"), "llm_pick", slots.alias("candidates"))


def pending_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Labeled titles that no verdict has answered."""
    titles = table(spark, folder, "human_labels_201", "row_id", "catalog", F.col("generated_title").alias("title"))
    done = table(spark, folder, "verdicts", "catalog", "title", "judged")
    return judging.pending(titles, done, ["catalog", "title"], "row_id")


def _batches(spark: SparkSession, folder: str) -> DataFrame:
    return judging.batched(label_items(spark, folder), ["catalog"], ["row_id"])


def judge_prompts(spark: SparkSession, folder: str) -> DataFrame:
    items = _batches(spark, folder).withColumn("candidates", F.transform("candidates", lambda c: c["title"]))
    return judging.prompts(items, ["catalog"])


def parsed_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Picks read back from replies made of the labels' picks, some of them out of range or no numbers."""
    items = _batches(spark, folder)
    line = F.concat(F.lit("item "), F.col("item").cast("string"), F.lit(": "), F.coalesce("llm_pick", F.lit("?")), F.lit(" done"))
    lines = F.array_sort(F.collect_list(F.struct("item", line.alias("text"), F.size("candidates").alias("n"))))
    replies = items.groupBy("catalog", "batch").agg(lines.alias("l")).select("catalog", "batch", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("reply"), F.transform("l", lambda x: x["n"]).alias("n_cands"))
    return judging.parse_replies(replies, ["catalog", "batch"])


def _with_quartiles(items: DataFrame, entries: DataFrame) -> DataFrame:
    """Items whose candidates also hold the quartile of their entry, of repeated entries the last."""
    known = entries.groupBy("catalog", "item_id").agg(F.max_by("popularity_quartile", "row_id").alias("quartile"))
    each = items.select("row_id", "catalog", F.posexplode("candidates").alias("at", "c")).withColumn("item_id", F.col("c.item_id")).join(known, ["catalog", "item_id"], "left")
    full = each.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("at", "c.title", "item_id", "quartile"))).alias("full"))
    empty = F.array().cast("array<struct<at:int,title:string,item_id:string,quartile:string>>")
    return items.join(full, "row_id", "left").withColumn("candidates", F.coalesce("full", empty)).drop("full")


def judge_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts of the judge that compares normal forms, by way of prompts and replies, with the quartiles of the matches."""
    items = _with_quartiles(_batches(spark, folder), table(spark, folder, "catalog", "row_id", "catalog", "item_id", "popularity_quartile"))
    asked = judging.prompts(items.withColumn("candidates", F.transform("candidates", lambda c: c["title"])), ["catalog"])
    replies = judging.judge(asked, judging.equal_title_judge)
    counts = items.groupBy("catalog", "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("item", F.size("candidates").alias("n")))), lambda x: x["n"]).alias("n_cands"))
    picks = judging.parse_replies(replies.join(counts, ["catalog", "batch"]), ["catalog", "batch"])
    return judging.verdicts(items, picks, ["catalog", "batch"]).select("row_id", "judged", "in_catalog", "match_title", "match_id", "match_quartile")


def json_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of JSON texts, null where they are none."""
    rows = table(spark, folder, "events", "event_id", "props")
    return rows.select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


def parsed_dates(spark: SparkSession, folder: str) -> DataFrame:
    from cresset.sources.files import epoch_seconds

    rows = table(spark, folder, "orders", "o_orderkey", "o_orderdate")
    return rows.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("d")).select("o_orderkey", epoch_seconds("d").alias("seconds"))


_CATALOG = """
WITH items AS (SELECT catalog, item_id FROM catalog WHERE item_id IS NOT NULL GROUP BY ALL),
counts AS (SELECT catalog, item_id, count(*) AS n FROM interactions GROUP BY ALL),
counted AS (SELECT i.catalog, i.item_id, coalesce(n, 0) AS interaction_count FROM items i LEFT JOIN counts c USING (catalog, item_id)),
places AS (SELECT *, row_number() OVER (PARTITION BY catalog ORDER BY interaction_count DESC, item_id) - 1 AS r, count(*) OVER (PARTITION BY catalog) - 1 AS m FROM counted),
quartiles AS (SELECT catalog, item_id, interaction_count, 'Q' || (1 + (4 * r > m)::INT + (4 * r > 2 * m)::INT + (4 * r > 3 * m)::INT) AS popularity_quartile FROM places)
"""
_SPLIT = f"""
eligible AS (SELECT user_id, count(*) AS n FROM interactions WHERE user_id IS NOT NULL GROUP BY 1 HAVING count(*) >= {LEAST_ROWS}),
placed AS (SELECT user_id, row_number() OVER (ORDER BY (CAST(substr(user_id, 2) AS BIGINT) * 2654435761) % 4294967296, user_id) AS p FROM eligible),
split AS (SELECT user_id, CASE WHEN p <= {N_AUDIT} THEN 'audit' ELSE 'calibration' END AS part FROM placed WHERE p <= {N_AUDIT + N_CALIBRATION}),
own AS (SELECT user_id, part, concat_ws(':', catalog, item_id) AS item_id, CASE WHEN catalog = 'amazon' THEN timestamp / 1000 ELSE timestamp::DOUBLE END AS t FROM interactions JOIN split USING (user_id)),
histories AS (
  SELECT user_id, part, row_number() OVER w AS place, item_id, row_number() OVER w = count(*) OVER (PARTITION BY user_id) AS is_target, count(*) OVER (PARTITION BY user_id) AS n
  FROM own WINDOW w AS (PARTITION BY user_id ORDER BY t NULLS FIRST, item_id))
"""
_INDEX = """
WITH entries AS (SELECT DISTINCT catalog, item_id, normalized_title AS f FROM catalog WHERE normalized_title <> ''),
sizes AS (SELECT catalog, count(*) AS n FROM entries GROUP BY 1),
each AS (SELECT catalog, item_id, unnest(list_distinct(list_filter(string_split(f, ' '), lambda t: t <> ''))) AS token FROM entries),
weights AS (SELECT catalog, token, count(*) AS df, n, ln(n / (1.0 + count(*))) AS idf FROM each JOIN sizes USING (catalog) GROUP BY catalog, token, n)
"""
_CANDS = ", ".join(f"{{'title': cand_{k}, 'item_id': cand_{k}_id}}" for k in range(1, 9))
_BATCHES = f"""
WITH items AS (
  SELECT row_id, catalog, coalesce(generated_title, '') AS title, llm_pick, list_filter([{_CANDS}], lambda c: c.title IS NOT NULL AND c.title <> '') AS c,
         row_number() OVER (PARTITION BY catalog ORDER BY row_id) - 1 AS p FROM human_labels_201),
batched AS (SELECT *, p // 10 AS batch, p % 10 + 1 AS item FROM items)
"""



def set_text(x: str) -> str:
    return f"array_to_string({set_sql(x)}, ' ')"


_PAIRS = f"""
WITH asked AS (SELECT query, catalog, f AS q FROM (SELECT DISTINCT catalog || '|' || generated_title AS query, catalog, {sort_sql(normal_sql('generated_title'))} AS f FROM human_labels_201 WHERE generated_title IS NOT NULL) WHERE f <> ''),
entries AS (SELECT catalog, item_id, f FROM (SELECT DISTINCT catalog, item_id, {sort_sql(fold_sql('title'))} AS f FROM catalog WHERE title IS NOT NULL) WHERE f <> ''),
pairs AS MATERIALIZED (SELECT query, item_id, q, f FROM asked JOIN entries USING (catalog))"""
_SEARCH = f"""{_PAIRS},
scored AS MATERIALIZED (SELECT query, item_id, max({ratio_sql('q', 'f', '(' + common_sql('q', 'f') + ')')}) AS score FROM pairs GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item_id)::INT AS place FROM scored QUALIFY place <= 12)
"""
_RETRIEVED = f"""
WITH asked AS MATERIALIZED (SELECT *, {sort_sql('a')} AS x FROM (SELECT DISTINCT catalog, generated_title, {fold_sql('generated_title')} AS a FROM human_labels_201 WHERE generated_title IS NOT NULL) WHERE a <> ''),
entries AS MATERIALIZED (SELECT *, {sort_sql('f')} AS y FROM (SELECT catalog, item_id, {fold_sql('title')} AS f FROM catalog WHERE title IS NOT NULL) WHERE f <> ''),
each AS (SELECT catalog, item_id, unnest({set_sql('f')}) AS token FROM entries),
sizes AS (SELECT catalog, count(*) AS n FROM entries GROUP BY 1),
weights AS (SELECT catalog, token, ln(n / (1.0 + count(*))) AS idf FROM each JOIN sizes USING (catalog) GROUP BY catalog, token, n HAVING count(*) <= 0.02 * n),
wanted AS (SELECT catalog, generated_title, unnest({set_sql('a')}) AS token FROM asked),
rare AS (SELECT catalog, generated_title, item_id, round(sum(idf), 6) AS score FROM wanted JOIN (SELECT DISTINCT * FROM each) USING (catalog, token) JOIN weights USING (catalog, token) GROUP BY ALL),
by_rare AS (SELECT *, row_number() OVER (PARTITION BY catalog, generated_title ORDER BY score DESC, item_id) AS p FROM rare QUALIFY p <= 12),
pairs AS MATERIALIZED (SELECT catalog, generated_title, item_id, x, y FROM asked JOIN entries USING (catalog)),
lengths AS MATERIALIZED (SELECT x, y, {common_sql('x', 'y')} AS n FROM (SELECT DISTINCT x, y FROM pairs)),
compared AS (SELECT catalog, generated_title, item_id, max({ratio_sql('x', 'y', 'n')}) AS score FROM pairs JOIN lengths USING (x, y) GROUP BY ALL),
by_text AS (SELECT *, row_number() OVER (PARTITION BY catalog, generated_title ORDER BY score DESC, item_id) AS p FROM compared QUALIFY p <= 12),
both_ways AS (SELECT catalog, generated_title, item_id, min(100 * block + p) AS nth FROM (SELECT catalog, generated_title, item_id, 0 AS block, p FROM by_rare UNION ALL SELECT catalog, generated_title, item_id, 1, p FROM by_text) GROUP BY ALL)
SELECT catalog, generated_title AS title, item_id, row_number() OVER (PARTITION BY catalog, generated_title ORDER BY nth)::INT AS place FROM both_ways QUALIFY place <= 8"""

ORACLE: dict[str, str] = {
    **reference_queries.ORACLE,
    **score_queries.ORACLE,
    **audit_queries.ORACLE,
    "catalog_popularity_quartile": _CATALOG + "SELECT * FROM quartiles",
    "eligible_users": f"SELECT user_id, count(*) AS n FROM interactions WHERE user_id IS NOT NULL GROUP BY 1 HAVING count(*) >= {LEAST_ROWS}",
    "user_split": "WITH" + _SPLIT + "SELECT user_id, part FROM split",
    "user_histories": "WITH" + _SPLIT + "SELECT user_id, part, place, item_id, is_target FROM histories WHERE n >= 2",
    "holdout_users": _CATALOG + "," + _SPLIT + "SELECT h.user_id, h.part, h.item_id AS target_item_id, coalesce(q.popularity_quartile, 'Q4') AS target_quartile, place - 1 AS n_history FROM histories h LEFT JOIN quartiles q ON h.item_id = concat_ws(':', q.catalog, q.item_id) WHERE is_target AND n >= 2",
    "holdout_arrays": "WITH" + _SPLIT + "SELECT user_id, string_agg(item_id, ' ' ORDER BY place) FILTER (NOT is_target) AS history, max(item_id) FILTER (is_target) AS target_item_id FROM histories WHERE n >= 2 GROUP BY 1",
    "normalized_titles": f"SELECT row_id, {normal_sql('title')} AS normalized FROM catalog",
    "token_sortkey": f"SELECT row_id, {sort_sql('normalized_title')} AS sort_key FROM catalog",
    "title_year": rf"SELECT row_id, nullif(regexp_extract(title, '[{SPACES}]*\((\d{{4}})\)[{SPACES}]*$', 1), '') AS year FROM verdicts",
    "short_title_guard": f"""
WITH p AS (SELECT row_id, {set_sql(normal_sql('title'))} AS q, {set_sql(normal_sql('match_title'))} AS f,
  len(list_filter(string_split({normal_sql('title')}, ' '), lambda t: t <> '')) AS nq, len(list_filter(string_split({normal_sql('match_title')}, ' '), lambda t: t <> '')) AS nf
  FROM verdicts WHERE title IS NOT NULL AND match_title <> '')
SELECT row_id, CASE WHEN nq = 0 OR nf = 0 THEN true WHEN least(nq, nf) > 3 THEN false ELSE q <> f END AS conflict, q = f AS agree FROM p""",
    "token_idf": _INDEX + "SELECT catalog, token, df, round(idf, 6) AS idf FROM weights",
    "rare_token_topk": _INDEX
    + f""", queries AS (SELECT DISTINCT catalog || '|' || generated_title AS query, catalog, {normal_sql('generated_title')} AS f FROM human_labels_201 WHERE generated_title IS NOT NULL),
asked AS (SELECT query, catalog, unnest(list_distinct(list_filter(string_split(f, ' '), lambda t: t <> ''))) AS token FROM queries),
postings AS (SELECT DISTINCT catalog, item_id, token FROM each),
scores AS (SELECT query, item_id, round(sum(idf), 6) AS score FROM asked JOIN postings USING (catalog, token) JOIN weights USING (catalog, token) WHERE df <= 0.02 * n GROUP BY ALL)
SELECT query, item_id, score FROM scores QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, item_id) <= 12""",
    "pending_titles": "SELECT catalog, generated_title AS title, min(row_id) AS first FROM human_labels_201 v WHERE generated_title IS NOT NULL AND NOT EXISTS (SELECT 1 FROM verdicts d WHERE d.judged AND d.catalog = v.catalog AND d.title = v.generated_title) GROUP BY ALL",
    "judge_prompts": _BATCHES
    + r"""SELECT catalog, batch, count(*)::INT AS n_items, string_agg(item || '. ' || title || CASE WHEN len(c) > 0 THEN E'\n' || array_to_string(list_transform(c, lambda x, k: '  ' || k || ') ' || x.title), E'\n') ELSE '' END, E'\n' ORDER BY item) AS prompt
FROM batched GROUP BY ALL""",
    "cost_estimate": _BATCHES
    + rf""", prompts AS (SELECT '1. ' || title || CASE WHEN len(c) > 0 THEN E'\n' || array_to_string(list_transform(c, lambda x, k: '  ' || k || ') ' || x.title), E'\n') ELSE '' END AS prompt FROM batched),
s AS (SELECT (SELECT count(*) FROM verdicts) AS n_verdicts, avg(length(prompt)) AS mean_chars, CAST(ceil((SELECT count(*) FROM verdicts) / 10) AS BIGINT) AS n_calls FROM prompts)
SELECT n_verdicts, n_calls, n_verdicts * 8 AS tokens_out, round(mean_chars, 6) AS mean_chars, round(n_verdicts * mean_chars / 4 + n_calls * {len(judging.SYSTEM)} / 4, 6) AS tokens_in,
  round(((n_verdicts * mean_chars / 4 + n_calls * {len(judging.SYSTEM)} / 4) * 3.0 + n_verdicts * 8 * 15.0) / 1e6, 6) AS price FROM s""",
    "folded_titles": f"SELECT row_id, CASE WHEN title IS NULL THEN '' ELSE {fold_sql('title')} END AS folded FROM catalog",
    "surface_forms": f"SELECT row_id, unnest({forms_sql('title', KIND)}) AS form FROM catalog WHERE title IS NOT NULL",
    "title_ratios": f"""
WITH p AS (SELECT row_id, catalog, title, match_title, {fold_sql('title')} AS a, {fold_sql('match_title')} AS b, {forms_sql('match_title', KIND)} AS forms FROM verdicts WHERE title IS NOT NULL AND match_title <> ''),
sorted AS (SELECT *, {sort_sql('a')} AS x, {sort_sql('b')} AS y, {token_set_parts('a', 'b')['shared']} AS shared, {token_set_parts('a', 'b')['rest_a']} AS rest_a, {token_set_parts('a', 'b')['rest_b']} AS rest_b FROM p),
each AS (SELECT row_id, a, x, unnest(forms) AS f FROM sorted WHERE a <> '' AND NOT (catalog = 'movielens' AND coalesce({year_sql('title')} <> {year_sql('match_title')}, false))),
forms AS (SELECT row_id, x, {sort_sql('f')} AS f FROM each WHERE NOT ({short_sql('a', 'f')})),
best AS (SELECT row_id, max({ratio_sql('x', 'f', '(' + common_sql('x', 'f') + ')')}) AS s FROM forms GROUP BY 1)
SELECT row_id, round({ratio_sql('a', 'b', '(' + common_sql('a', 'b') + ')')}, 6) AS indel, round({ratio_sql('x', 'y', '(' + common_sql('x', 'y') + ')')}, 6) AS token_sort,
  round({token_set_sql('(' + common_sql('rest_a', 'rest_b') + ')')}, 6) AS token_set, CASE WHEN a <> '' THEN round(coalesce(s, 0.0), 6) END AS score FROM sorted LEFT JOIN best USING (row_id)""",
    "fuzzy_topk": f"""{_SEARCH} SELECT query, item_id, round(score, 6) AS score, place FROM top""",
    "full_catalog_best": f"""{_PAIRS}, sets AS (SELECT query, {set_text('q')} AS a, {set_text('f')} AS b FROM asked JOIN entries USING (catalog)),
parts AS (SELECT query, {token_set_parts('a', 'b')['shared']} AS shared, {token_set_parts('a', 'b')['rest_a']} AS rest_a, {token_set_parts('a', 'b')['rest_b']} AS rest_b FROM sets),
likely AS MATERIALIZED (SELECT * FROM parts WHERE {token_set_sql(most_common_sql('rest_a', 'rest_b'))} >= 90),
by_set AS (SELECT DISTINCT query FROM likely WHERE {token_set_sql('(' + common_sql('rest_a', 'rest_b') + ')')} >= 90),
near AS MATERIALIZED (SELECT query, q, f FROM pairs WHERE {ratio_sql('q', 'f', most_common_sql('q', 'f'))} >= 90),
by_sort AS (SELECT DISTINCT query FROM near WHERE {ratio_sql('q', 'f', '(' + common_sql('q', 'f') + ')')} >= 90)
SELECT query, query IN (FROM by_set) AS token_set, query IN (FROM by_sort) AS token_sort FROM asked""",
    "retrieved_candidates": _RETRIEVED,
    "judge_verdicts": _BATCHES
    + f""", picked AS (SELECT row_id, catalog, c, list_position(list_transform(c, lambda x: {fold_sql('x.title')}), {fold_sql('title')}) AS pick FROM batched)
SELECT row_id, true AS judged, pick IS NOT NULL AS in_catalog, CASE WHEN pick IS NULL THEN '' ELSE c[pick].title END AS match_title, CASE WHEN pick IS NULL THEN '' ELSE c[pick].item_id END AS match_id,
  CASE WHEN pick IS NULL THEN '' ELSE coalesce((SELECT arg_max(popularity_quartile, row_id) FROM catalog k WHERE k.catalog = picked.catalog AND k.item_id = c[pick].item_id), '') END AS match_quartile FROM picked""",
    "parsed_replies": _BATCHES + "SELECT catalog, batch, item, try_cast(llm_pick AS INT) AS pick FROM batched WHERE try_cast(llm_pick AS INT) BETWEEN 0 AND len(c)",
    "json_fields": "SELECT event_id, try_cast(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "parsed_dates": "SELECT o_orderkey, epoch(date_trunc('second', o_orderdate))::BIGINT AS seconds FROM orders",
}
ORACLE["full_catalog_rates"] = ORACLE["full_catalog_rates"].replace("full_catalog_best_here", f"({ORACLE['full_catalog_best']})")

QUERIES = {
    f.__name__: f
    for f in (
        catalog_popularity_quartile, eligible_users, user_split, user_histories, holdout_users, holdout_arrays, normalized_titles, token_sortkey, title_year,
        folded_titles, surface_forms, short_title_guard, title_ratios, token_idf, rare_token_topk, fuzzy_topk, full_catalog_best, retrieved_candidates, pending_titles,
        judge_prompts, parsed_replies, judge_verdicts, json_fields, parsed_dates,
    )
} | {**score_queries.QUERIES, **audit_queries.QUERIES, **reference_queries.QUERIES}

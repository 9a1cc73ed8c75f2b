"""The library's queries over the supplied tables, and SQL that must agree with them.

Adapters turn the supplied tables into the operators' inputs: `lineitem` into pixels, boxes and scores, `part` into
terms, region, nation and customer into a hierarchy, `events` into a log.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as T
from quillon.operators import audit, engine, fusion, index_store, lifecycle, matching, metrics, policies, retrieval, sampling
from quillon.session import shared_dir
from quillon.sources import ontology
from quillon.streaming import logs, state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- adapters -------------------------------------------------------------------------------------------------------
def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    patch = "(l_orderkey div 30)"
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"{patch} patch", "case when l_returnflag = 'R' and l_linestatus = 'F' and l_tax <= 0.02 then 0 else l_suppkey % 7 + 1 end truth",
        f"case when l_discount >= 0.09 then 0 when l_suppkey % 7 = 6 and {patch} % 4 = 1 then 1 when l_linenumber * 7 <= {patch} % 49 then (l_suppkey + 1) % 7 + 1 else l_suppkey % 7 + 1 end pred", "l_tax = 0.08 ignored",
    )


PX = """with px as (select l_orderkey // 30 as patch, case when l_returnflag = 'R' and l_linestatus = 'F' and l_tax <= 0.02 then 0 else l_suppkey % 7 + 1 end as truth,
 case when l_discount >= 0.09 then 0 when l_suppkey % 7 = 6 and (l_orderkey // 30) % 4 = 1 then 1 when l_linenumber * 7 <= (l_orderkey // 30) % 49 then (l_suppkey + 1) % 7 + 1 else l_suppkey % 7 + 1 end as pred,
 l_tax = 0.08 as ignored from lineitem),
 pa as (select patch, pred, count(*) as a from px where pred > 0 and not ignored group by all), ta as (select patch, truth, count(*) as b from px where truth > 0 and not ignored group by all),
 ov as (select o.patch, o.pred, o.truth, n as inter, a, b, n / (a + b - n)::double as iou from (select patch, pred, truth, count(*) as n from px where pred > 0 and truth > 0 and not ignored group by all) o join pa using (patch, pred) join ta using (patch, truth)),
 m as (select patch, pred, truth, iou from ov where iou > 0.5),
 ev as (select patch, 'tp' as kind, pred, truth, iou from m union all select patch, 'fp', pred, null, 0 from pa anti join m using (patch, pred) union all select patch, 'fn', null, truth, 0 from ta anti join m using (patch, truth)),
 te as (select patch, pred % 5 + 1 as class, 1 as tp, 0 as fp, 0 as fn, iou from ev where kind = 'tp' and pred % 5 = truth % 5
  union all select patch, pred % 5 + 1, 0, 1, 0, 0 from ev where kind = 'fp' or (kind = 'tp' and pred % 5 <> truth % 5)
  union all select patch, truth % 5 + 1, 0, 0, 1, 0 from ev where kind = 'fn' or (kind = 'tp' and pred % 5 <> truth % 5))
"""
METRICS = """round(case when tp + fp > 0 then tp / (tp + fp)::double else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn)::double else 0 end, 6) as recall,
 round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn)::double else 0 end, 6) as f1, round(case when tp + fp + fn > 0 then sum_iou / (tp + (fp + fn) / 2.0::double) else 0 end, 6) as pq"""


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    return matching.outcomes(px, matching.match(px))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query vectors: every row whose id is divisible by 20, against all rows."""
    return vectors(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.col("label").alias("query_label"))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey id", "p_name name", "p_size > 45 obsolete")


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = terms(spark, sf_dir).where("not obsolete")
    return live.selectExpr("id", "name alias", "true is_name").union(live.selectExpr("id", "substring_index(name, ' ', -1)", "false"))


def term_index(spark: SparkSession, sf_dir: str) -> engine.Index:
    """Built by the first query that asks for it, opened by the others as long as the table's files are the same."""

    def tables() -> tuple[DataFrame, DataFrame, DataFrame]:
        t = terms(spark, sf_dir).withColumn("definition", F.lit(None).cast("string"))
        none = spark.createDataFrame([], "id long, kind string, target long")
        return t, t.select("id", F.substring_index("name", " ", -1).alias("value")), none

    return index_store.opened(spark, f"{shared_dir(spark)}/terms", [f"{sf_dir}/part.parquet"], tables)


ALIASES = "select p_partkey as id, p_name as alias, true as is_name from part where p_size <= 45 union all select p_partkey, list_extract(string_split(p_name, ' '), -1), false from part where p_size <= 45"
WORDS = ["", "blue", "  green small ", "hot", "copper large green", "a"]


def asked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few literal queries and the names of all parts whose id is divisible by 20."""
    names = table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(F.col("p_name").alias("query"))
    return names.union(spark.createDataFrame([(w,) for w in WORDS], "query string")).distinct()


ASKED = "select distinct query from (select p_name as query from part where p_partkey % 20 = 0 union all select unnest(['', 'blue', '  green small ', 'hot', 'copper large green', 'a']))"
LEXICAL = f"""with q as (select query, lower(trim(query)) as q from ({ASKED})), a as (select id, is_name, lower(alias) as a from ({ALIASES})),
 tok as (select *, list_distinct(regexp_extract_all(q, '[\\p{{L}}\\p{{N}}_]+')) as qw from q),
 s as (select query, id, case when a = q and is_name then 10000 when a = q then 9000 when length(q) > 0 and (contains(a, q) or contains(q, a)) then 100 + len(list_intersect(qw, list_distinct(list_filter(regexp_split_to_array(trim(a), '\\s+'), lambda x: x <> '')))) end as s1,
  case when is_name then nullif(len(list_intersect(qw, regexp_extract_all(a, '[\\p{{L}}\\p{{N}}_]+'))), 0) end as s2 from tok, a),
 sc as (select query, id, cast(max(greatest(s1, s2)) as bigint) as score from s where s1 is not null or s2 is not null group by all)
"""


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    up = nation.selectExpr("concat('R', n_regionkey) parent", "concat('N', n_nationkey) child", "'is_a' relation")
    return up.union(customer.selectExpr("concat('N', c_nationkey)", "concat('C', c_custkey)", "'part_of'"))


EDGES = "select concat('R', n_regionkey) as parent, concat('N', n_nationkey) as child, 'is_a' as relation from nation union all select concat('N', c_nationkey), concat('C', c_custkey), 'part_of' from customer"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("action"), "value", F.get_json_object("props", "$.k").alias("k"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of orders: a price's share, and whether it is a finished order."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 500000, 2).alias("s"), F.expr("case when o_orderstatus = 'F' then 1 else 0 end").alias("y"))


SCORES = "select o_orderkey as id, round(o_totalprice / 500000, 2) as s, case when o_orderstatus = 'F' then 1 else 0 end as y from orders"
GRID = "select 0.05::double + i * 0.05::double as threshold from range(19) t(i)"
SWEEP = f"""with sc as ({SCORES}), c as (select threshold, cast(count(*) filter (where s::float >= threshold::float and y = 1) as bigint) as tp, cast(count(*) filter (where s::float >= threshold::float and y = 0) as bigint) as fp,
 cast(count(*) filter (where s::float < threshold::float and y = 1) as bigint) as fn, 0.0::double as sum_iou from sc, ({GRID}) g group by all), w as (select round(threshold, 6) as threshold, tp, fp, fn, {METRICS} from c)
"""


def boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Boxes from distinct (order, line) values: truths, and detections shifted by the discount."""
    lines = table(spark, sf_dir, "lineitem").select("*", F.expr("l_orderkey div 20").alias("image"), F.expr("cast(l_linenumber % 3 as int)").alias("cls"))
    # lines are dealt by image and class, as the matching needs them, so that boxes aren't moved again
    base = lines.repartition("image", "cls").groupBy("image", "cls", "l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_discount").alias("d"), F.min("l_quantity").alias("q"))
    base = base.selectExpr("image", "cls", "l_orderkey * 10 + l_linenumber i", "cast(p % 90 as double) x", "cast(s % 90 as double) y", "10 + q % 20 w", "d", "q")
    gt = base.selectExpr("image", "cls", "i truth_id", "named_struct('x1', x, 'y1', y, 'x2', x + w, 'y2', y + w) truth")
    det = base.where("d < 0.09").selectExpr("image", "cls", "i det_id", "1 - d - q / 1000 conf", "named_struct('x1', x + 60 * d, 'y1', y, 'x2', x + w + 60 * d, 'y2', y + w) box")
    return det, gt


# ---- retrieval ------------------------------------------------------------------------------------------------------
TOPK = "select a.vec_id as query_id, b.vec_id as id, list_dot_product(a.embedding::double[], b.embedding::double[]) as score, row_number() over (partition by a.vec_id order by score desc, b.vec_id) as rank, a.label as query_label, b.label as label from embeddings a, embeddings b where a.vec_id % 20 = 0"


@query(f"select query_id, id, round(score, 6) as score, rank from ({TOPK}) where rank <= 5")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.cosine_topk(asked(spark, sf_dir).drop("query_label"), vectors(spark, sf_dir)).withColumn("score", F.round("score", 6))


KNN = f"with nn as (select * from ({TOPK}) where id <> query_id qualify row_number() over (partition by query_id order by score desc, id) = 1)"


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    top = retrieval.cosine_topk(asked(spark, sf_dir).drop("query_label"), v, 2).where("id <> query_id")
    top = retrieval.rank_by(top.drop("rank"), "query_id", "score", "id", 1)
    return top.join(v.select("id", "label"), "id").join(asked(spark, sf_dir).select("query_id", "query_label"), "query_id")


@query(KNN + "select query_label, label, count(*) as n from nn group by all")
def knn_label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).groupBy("query_label", "label").agg(F.count("*").alias("n"))


@query(KNN + ", d as (select distinct label from embeddings), f as (select d.label, (select count(*) from nn where query_label = d.label and nn.label = d.label) as tp, (select count(*) from nn where query_label = d.label) as t, (select count(*) from nn where nn.label = d.label) as p from d) select round(avg(case when t + p > 0 then 2 * tp / (t + p)::double else 0 end), 6) as macro_f1 from f")
def knn_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = knn_label_confusion(spark, sf_dir)
    hit = F.when(F.col("query_label") == F.col("label"), F.col("n")).otherwise(0)
    t = n.groupBy(F.col("query_label").alias("c")).agg(F.sum("n").alias("t"), F.sum(hit).alias("tp"))
    p = n.groupBy(F.col("label").alias("c")).agg(F.sum("n").alias("p"))
    every = vectors(spark, sf_dir).select(F.col("label").alias("c")).distinct().join(t, "c", "left").join(p, "c", "left").fillna(0)
    return every.agg(F.round(F.avg(matching.ratio(2 * F.col("tp"), F.col("t") + F.col("p"))), 6).alias("macro_f1"))


@query(LEXICAL + "select query, id, score, rank from (select *, row_number() over (partition by query order by score desc, id) as rank from sc) where rank <= 20")
def lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine.lexical_top(asked_words(spark, sf_dir).withColumn("query_id", F.col("query")), term_index(spark, sf_dir), 20)
    return found.select(F.col("query_id").alias("query"), "id", "score", "rank")


@query(LEXICAL + "select query, count(*) as n, sum(score)::bigint as total from sc group by all")
def lexical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores again, by looking at every text that an alias has."""
    return retrieval.lexical_totals(asked_words(spark, sf_dir), aliases(spark, sf_dir))


@query(f"with q as (select query, lower(trim(query)) as q from ({ASKED})), qg as (select distinct query, substr(q, i, 3) as g from q, range(1, 60) t(i) where i <= length(q) - 2), ag as (select distinct id, substr(lower(alias), i, 3) as g from ({ALIASES}) a, range(1, 80) t(i) where i <= length(alias) - 2) select query, id from qg join ag using (g) join (select query, count(*) as need from qg group by all) n using (query) group by query, id, need having count(*) = need")
def ngram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.ngram_candidates(asked_words(spark, sf_dir), aliases(spark, sf_dir))


@query(f"with v as (select query_id, id, rank from ({TOPK})), l as (select query_id, id, row_number() over (partition by query_id order by abs(id - query_id), id) as rank from v), u as (select * from v union all select * from l), f as (select query_id, id, round(sum(1.0::double / (60 + rank)), 12) as score from u group by all) select query_id, id, round(score, 9) as score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from f) where rank <= 10")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, every = asked(spark, sf_dir).select("query_id", "q"), vectors(spark, sf_dir).select("id", "v")
    number = lambda c: F.array(F.col(c).cast("double"))
    near = (own.select("query_id", number("query_id").alias("q")), every.select("id", number("id").alias("v")), fusion.NEARNESS)
    return fusion.fused_lists([(own, every, fusion.COSINE), near], 10).withColumn("score", F.round("score", 9))


@query(LEXICAL + f", h as (select query, id, rank from (select *, row_number() over (partition by query order by score desc, id) as rank from sc) where rank <= 20), n as (select q.query, coalesce(max(rank), 0) as n from q left join h using (query) group by all), c as (select p_partkey as id from part where p_size <= 45), t as (select q.query, c.id, row_number() over (partition by q.query order by c.id) as r from q, c where not exists (select 1 from h where h.query = q.query and h.id = c.id)) select query, id, rank from h union all select query, id, r + n as rank from t join n using (query)")
def rank_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = terms(spark, sf_dir).where("not obsolete").select("id")
    return retrieval.complete(lexical_rank(spark, sf_dir), corpus, asked_words(spark, sf_dir))


@query(LEXICAL + f", r as (select query as case_id, id, rank from (select *, row_number() over (partition by query order by score desc, id) as rank from sc) where rank <= 20), g as (select query as case_id, p_partkey as id from ({ASKED}) q join part on lower(p_name) = lower(trim(query)) where p_size <= 45), h as (select case_id, min(rank) as first_rank, count(*) filter (where rank <= 5) as hits from r join g using (case_id, id) group by all), n as (select case_id, count(*) as n_gold from g group by all) select query as case_id, coalesce(n_gold, 0) as n_gold, coalesce(first_rank, 0) as first_rank, round(case when n_gold > 0 then coalesce(hits, 0) / n_gold::double else 0 end, 6) as recall, round(coalesce(1.0::double / first_rank, 0), 6) as mrr from ({ASKED}) b left join n on n.case_id = query left join h on h.case_id = query")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical ranking against the parts whose name is the query."""
    asked = asked_words(spark, sf_dir).withColumnRenamed("query", "case_id")
    named = terms(spark, sf_dir).where("not obsolete").select("id", F.lower("name").alias("q"))
    gold = asked.withColumn("q", F.lower(F.trim("case_id"))).join(named, "q").select("case_id", "id")
    return retrieval.retrieval_metrics(lexical_rank(spark, sf_dir).withColumnRenamed("query", "case_id"), gold, asked).fillna(0, ["first_rank"])


@query("select item_id, count(*) as n, min(doc_id) as first from benchmark b join documents d on contains(d.text, b.text) group by all")
def verbatim_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold word for word: candidates share an item's first words, then are compared."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("t"))
    return audit.containing(docs, "text", items, "t").groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


RED = "select p_partkey + 1000000 as id, 'alt_id' as kind, p_partkey as target from part where p_partkey % 10 = 0 union all select p_partkey, 'replaced_by', p_partkey + 1 from part where p_size > 45 and p_partkey % 3 = 0 union all select p_partkey, 'consider', p_partkey + t.i from part, range(1, 4) t(i) where p_size > 45 and p_partkey % 3 = 1"


@query(f"with q as (select p_partkey as query from part union all select p_partkey + 1000000 from part where p_partkey % 5 = 0), r as ({RED}), e as (select query, 0 as p, 'canonical' as kind, p_partkey as target from q join part on p_partkey = query where p_size <= 45 union all select query, 1, 'alternate', target from q join r on id = query where kind = 'alt_id' union all select query, 2, 'obsolete_replaced_by', target from q join r on id = query where kind = 'replaced_by' union all select query, 3, 'obsolete_consider', target from q join r on id = query where kind = 'consider' union all select query, 4, 'obsolete_unresolved', null from q join part on p_partkey = query where p_size > 45 union all select query, 5, 'unknown_identifier', null from q) select query, kind, array_to_string(list_sort(list(distinct target) filter (where target is not null)), ',') as targets from (select * from e qualify p = min(p) over (partition by query)) group by query, kind")
def resolve_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    queries = part.selectExpr("p_partkey query").union(part.where("p_partkey % 5 = 0").selectExpr("p_partkey + 1000000"))
    redirects = part.where("p_partkey % 10 = 0").selectExpr("p_partkey + 1000000 id", "'alt_id' kind", "p_partkey target")
    redirects = redirects.union(part.where("p_size > 45 and p_partkey % 3 = 0").selectExpr("p_partkey", "'replaced_by'", "p_partkey + 1")).union(part.where("p_size > 45 and p_partkey % 3 = 1").selectExpr("p_partkey", "'consider'", "explode(array(p_partkey + 1, p_partkey + 2, p_partkey + 3))"))
    found = retrieval.resolve(queries, terms(spark, sf_dir), redirects)
    return found.withColumn("targets", F.when(F.size("targets") > 0, F.array_join("targets", ",")))


@query(f"with recursive e as ({EDGES}), w as (select concat('R', r_regionkey) as start, concat('R', r_regionkey) as node, 0 as depth from region union select start, child, depth + 1 from w join e on parent = node where depth < 10) select start, node, min(depth)::int as depth from w where depth > 0 group by all")
def graph_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.walk(hierarchy(spark, sf_dir), table(spark, sf_dir, "region").selectExpr("concat('R', r_regionkey) start"), "descendants", 3)


@query(f"with recursive e as ({EDGES}), s as (select concat('C', c_custkey) as start from customer), w as (select start, start as node, 0 as depth from s union select start, parent, depth + 1 from w join e on child = node where depth < 2) select start, node, min(depth)::int as depth from w where depth > 0 group by all")
def graph_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = table(spark, sf_dir, "customer").selectExpr("concat('C', c_custkey) start")
    return retrieval.walk(hierarchy(spark, sf_dir), start, "ancestors", 2)


@query(f"with e as ({EDGES}) select relation, count(*) as n, count(distinct parent) as parents from e group by all")
def ontology_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.relation_counts(hierarchy(spark, sf_dir))


# ---- matching -------------------------------------------------------------------------------------------------------
@query(PX + "select patch, pred, truth, round(iou, 6) as iou from m")
def iou_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match(pixels(spark, sf_dir)).withColumn("iou", F.round("iou", 6))


@query(PX + "select count(*) filter (where kind = 'tp') as tp, count(*) filter (where kind = 'fp') as fp, count(*) filter (where kind = 'fn') as fn from ev")
def detection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).agg(*matching.counts_by_kind())


@query(PX + ", d as (select i::int as class from range(1, 6) t(i)), s as (select class, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(iou) as i from te group by all), c as (select d.class, coalesce(tp, 0)::bigint as tp, coalesce(fp, 0)::bigint as fp, coalesce(fn, 0)::bigint as fn, coalesce(i, 0)::double as sum_iou from d left join s on s.class = d.class) select class, tp, fp, fn, " + METRICS + " from c")
def typed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.class_scores(found(spark, sf_dir)).select("class", "tp", "fp", "fn", *matching.metric_columns())


@query(PX + ", c as (select count(*) filter (where kind = 'tp') as tp, count(*) filter (where kind = 'fp') as fp, count(*) filter (where kind = 'fn') as fn, sum(iou) as sum_iou from ev) select " + METRICS + " from c")
def panoptic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).agg(*matching.counts_by_kind(), F.sum("iou").alias("sum_iou")).select(*matching.metric_columns())


@query(PX + ", l as (select pa.patch, pa.pred from pa anti join m using (patch, pred)), o as (select ov.patch, ov.pred, inter >= 0.1 * least(a, b) as big, m.truth is not null as taken from ov left join m on m.patch = ov.patch and m.truth = ov.truth), s as (select patch, pred, count(*) filter (where big) as big, count(*) filter (where big and taken) as taken from o group by all) select case when big is null then 'background_only' when big = 0 then 'other_unresolved' when big > 1 then 'merge' when taken > 0 then 'split_fragment' else 'boundary_localization' end as category, count(*) as n from l left join s using (patch, pred) group by all")
def fp_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    return matching.false_positive_kinds(px, matching.match(px)).groupBy("category").agg(F.count("*").alias("n"))


@query(PX + ", p as (select distinct patch, pred, truth from px where pred > 0 and truth > 0) select (select count(*) from (select 1 from p group by patch, pred having count(*) > 1)) as merges, (select count(*) from (select 1 from p group by patch, truth having count(*) > 1)) as splits")
def merge_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.merge_split(pixels(spark, sf_dir))


@query(PX + ", c as (select (truth % 5 + 1)::int as truth_class, (pred % 5 + 1)::int as pred_class, count(*) as n from m group by all) select t::int as truth_class, p::int as pred_class, coalesce(n, 0) as n from range(1, 6) a(t) cross join range(1, 6) b(p) left join c on truth_class = t and pred_class = p")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.confusion(matching.match(pixels(spark, sf_dir)))


STRATA = "select o_orderkey // 30 as patch, arg_min(o_orderpriority, o_orderkey) as stratum from orders group by all"


@query(PX + f", st as ({STRATA}), c as (select stratum, count(*) filter (where kind = 'tp') as tp, count(*) filter (where kind = 'fp') as fp, count(*) filter (where kind = 'fn') as fn, sum(iou) as sum_iou from ev join st using (patch) group by all) select stratum, tp, fp, fn, " + METRICS + " from c")
def stratified_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the priority of each patch's first order."""
    strata = table(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey div 30").alias("patch")).agg(F.min_by("o_orderpriority", "o_orderkey").alias("stratum"))
    by = found(spark, sf_dir).join(strata, "patch").groupBy("stratum")
    return by.agg(*matching.counts_by_kind(), F.sum("iou").alias("sum_iou")).select("stratum", "tp", "fp", "fn", *matching.metric_columns())


@query(PX + ", b as (select unnest([0.5, 0.6, 0.7, 0.8])::double as lo, unnest([0.6, 0.7, 0.8, 1.0])::double as hi) select lo, hi, count(*) as n, count(*) filter (where pred % 5 = truth % 5) as right_type from m join b on iou > lo and iou <= hi group by all")
def iou_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.iou_bins(matching.match(pixels(spark, sf_dir)), [(0.5, 0.6), (0.6, 0.7), (0.7, 0.8), (0.8, 1.0)])


PICK = "list_filter(o.c, lambda x: x.t is not null and not list_contains(g.used, x.t))[1]"
BOXES = f"""with recursive base as (select l_orderkey, l_linenumber, min(l_partkey) as p, min(l_suppkey) as s, min(l_discount) as d, min(l_quantity) as q from lineitem group by all),
 b as (select l_orderkey // 20 as image, (l_linenumber % 3)::int as cls, l_orderkey * 10 + l_linenumber as i, (p % 90)::double as x, (s % 90)::double as y, 10 + q % 20 as w, d, q from base),
 gt as (select image, cls, i as truth_id, x as x1, y as y1, x + w as x2, y + w as y2 from b), det as (select image, cls, i as det_id, 1 - d - q / 1000 as conf, x + 60 * d as x1, y as y1, x + w + 60 * d as x2, y + w as y2 from b where d < 0.09),
 pairs as (select det.image, det.cls, det_id, conf, truth_id, greatest(0, least(det.x2, gt.x2) - greatest(det.x1, gt.x1)) * greatest(0, least(det.y2, gt.y2) - greatest(det.y1, gt.y1)) as inter, (det.x2 - det.x1) * (det.y2 - det.y1) as a, (gt.x2 - gt.x1) * (gt.y2 - gt.y1) as b from det left join gt using (image, cls)),
 o as (select image, cls, det_id, conf, list({{'iou': coalesce(inter / greatest(a + b - inter, 1e-9), 0), 't': truth_id}} order by coalesce(inter / greatest(a + b - inter, 1e-9), 0) desc, truth_id desc) as c from pairs group by all),
 k as (select *, row_number() over (partition by image, cls order by conf desc, det_id) as k from o),
 g as (select image, cls, 0::bigint as k, []::bigint[] as used, null::bigint as det_id, null::double as conf, false as hit from (select distinct image, cls from o)
  union all select o.image, o.cls, o.k, case when coalesce({PICK}.iou, 0) >= 0.5 then list_append(g.used, {PICK}.t) else g.used end, o.det_id, o.conf, coalesce({PICK}.iou, 0) >= 0.5 from g join k o on o.image = g.image and o.cls = g.cls and o.k = g.k + 1),
 h as (select image, cls, det_id, conf, hit from g where k > 0)
"""


@query(BOXES + "select * from h")
def box_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.box_matches(*boxes(spark, sf_dir))


@query(BOXES + ", n as (select cls, count(*) as n from gt group by all), w as (select cls, sum(hit::int) over v as tp, row_number() over v as k from h window v as (partition by cls order by conf desc, image, det_id rows unbounded preceding)), e as (select cls, tp / n::double as recall, max(tp / k::double) as p from w join n using (cls) group by cls, tp, n), t as (select cls, i, max(p) as p from e join range(101) r(i) on recall >= i / 100.0::double group by all) select c::int as cls, round(coalesce((select sum(p) / 101 from t where t.cls = c), 0), 6) as ap from range(3) d(c)")
def box_ap50(spark: SparkSession, sf_dir: str) -> DataFrame:
    det, gt = boxes(spark, sf_dir)
    return matching.ap50(matching.box_matches(det, gt), gt)


DETECTOR = BOXES + """, n as (select cls, count(*) as n from gt group by all), th as (select round(0.7 + 0.02 * i, 2)::double as threshold from range(12) t(i)), dm as (select c::int as cls, threshold from range(3) d(c), th),
 gk as (select threshold, cls, count(*) filter (where hit) as tp, count(*) as k from h join th on conf >= threshold group by all),
 pc as (select dm.threshold, coalesce(tp, 0) as tp, coalesce(k, 0) as k, coalesce(n, 0) as n from dm left join gk using (threshold, cls) left join n using (cls)),
 ds as (select threshold, round(avg(case when k + n > 0 then 2 * tp / (k + n)::double else 0 end), 6) as macro_f1, round(min(case when n > 0 then tp / n::double else 0 end), 6) as min_recall, round(avg(case when n > 0 then tp / n::double else 0 end), 6) as mean_recall, round(sum(tp) / sum(n)::double, 6) as recall from pc group by all)
"""


def _detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    det, gt = boxes(spark, sf_dir)
    thresholds = spark.range(12).select(F.round(F.lit(0.7) + F.lit(0.02) * F.col("id"), 2).alias("threshold"))
    return matching.detector_scores(matching.box_matches(det, gt), gt, thresholds)


@query(DETECTOR + "select * from ds")
def detector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detector(spark, sf_dir)


@query(DETECTOR + "select * from ds order by macro_f1 desc, min_recall desc, mean_recall desc, threshold limit 1")
def detector_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.chosen_threshold(_detector(spark, sf_dir))


GREEDY = PX.replace("with px", "with recursive px", 1) + """, c as (select patch, pred, truth, iou, row_number() over (partition by patch order by iou desc, pred desc, truth desc) as k from ov where iou > 0.3),
 g as (select patch, 0::bigint as k, []::bigint[] as ps, []::bigint[] as ts, null::bigint as pred, null::bigint as truth, null::double as iou, false as ok from (select distinct patch from c)
  union all select c.patch, c.k, case when not list_contains(ps, c.pred) and not list_contains(ts, c.truth) then list_append(ps, c.pred) else ps end, case when not list_contains(ps, c.pred) and not list_contains(ts, c.truth) then list_append(ts, c.truth) else ts end, c.pred, c.truth, c.iou, not list_contains(ps, c.pred) and not list_contains(ts, c.truth) from g join c on c.patch = g.patch and c.k = g.k + 1)
"""


@query(GREEDY + "select patch, pred, truth, round(iou, 6) as iou from g where ok")
def greedy_below_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_greedy(pixels(spark, sf_dir), 0.3).withColumn("iou", F.round("iou", 6))


# ---- scores ---------------------------------------------------------------------------------------------------------
@query(SWEEP + "select threshold, tp, fp, fn, precision, recall, f1 from w")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sweep(scores(spark, sf_dir), metrics.threshold_grid(spark))


@query(SWEEP + "select threshold, f1, recall, recall >= 0.2 as eligible from w order by eligible desc, f1 desc, threshold limit 1")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best(threshold_sweep(spark, sf_dir))


@query(f"with b as (select s, sum(y) as p, count(*) as n from ({SCORES}) group by s), r as (select p, n, coalesce(sum(n) over (order by s rows between unbounded preceding and 1 preceding), 0) + (n + 1) / 2.0::double as k from b), t as (select sum(k * p) as r, sum(p)::double as p, sum(n)::double as n from r) select round((r - p * (p + 1) / 2) / (p * (n - p)), 6) as auroc from t")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auroc(scores(spark, sf_dir))


@query(f"with b as (select s, sum(y) as p, count(*) as n from ({SCORES}) group by s), r as (select p, sum(p) over w as tp, sum(n) over w as k from b window w as (order by s desc rows unbounded preceding)) select round(sum(p * tp / k::double) / sum(p), 6) as average_precision from r")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(scores(spark, sf_dir))


@query(SWEEP + ", o as (select max(f1) as f1, max(recall) as recall, min(precision) as precision from w), g as (select unnest(['f1', 'precision', 'recall']) as metric, unnest([0.5, 0.5, 0.9])::double as floor) select metric, case metric when 'f1' then f1 when 'recall' then recall else precision end as value, floor, case metric when 'f1' then f1 when 'recall' then recall else precision end >= floor as passed from o, g")
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = threshold_sweep(spark, sf_dir).agg(F.max("f1").alias("f1"), F.max("recall").alias("recall"), F.min("precision").alias("precision"))
    return metrics.gates(one, {"f1": 0.5, "precision": 0.5, "recall": 0.9})


@query("select event_type, count(*) as n, round(ln(1 + count(*)) / 10, 6) as log_area, round(avg(value), 6) as value_mean, round(sqrt(greatest(avg(value * value) - avg(value) * avg(value), 0)), 5) as value_std from events group by all")
def pooled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.pooled(table(spark, sf_dir, "events"), ["event_type"], ["value"])


@query("select l_returnflag, round(avg(c), 6) as mean, round(stddev_pop(c), 6) as std, round(min(c), 6) as low, round(max(c), 6) as high from (select l_returnflag, 1 / (1 + exp(-(l_discount * 10 - l_tax * 20))) as c from lineitem) group by all")
def confidence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag", "l_discount * 10 - l_tax * 20 z")
    return policies.confidence_features(z, ["l_returnflag"], "z")


@query("with c as (select l_orderkey % 50 as patch, l_suppkey % 7 + 1 as id, l_linenumber % 5 + 1 as class, count(*) as n from lineitem group by all) select patch, id, arg_max(class, (n, -class))::int as class from c group by all")
def majority_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 50 patch", "l_suppkey % 7 + 1 id", "cast(l_linenumber % 5 + 1 as int) class")
    return policies.majority_class(px, ["patch", "id"], "class")


@query("select lang, round(quantile_cont(n_chars, 0.1), 6) as p10, round(quantile_cont(n_chars, 0.5), 6) as p50, round(quantile_cont(n_chars, 0.9), 6) as p90, round(quantile_cont(n_chars, 0.75) - quantile_cont(n_chars, 0.25), 6) as iqr from documents group by all")
def percentile_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.percentile_features(table(spark, sf_dir, "documents"), "n_chars", "lang")


@query("select event_type, quantile_disc(value, 0.95) as p_nearest from events group by all")
def latency_nearest_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.percentile_nearest(table(spark, sf_dir, "events"), "value", "event_type", 0.95)


@query("with r as (select event_type, value, row_number() over (partition by event_type order by value, event_id) as k, count(*) over (partition by event_type) as n from events) select event_type, max(value) filter (where k = greatest(1, floor(0.95 * n))) as p_floor, max(value) filter (where k = n // 2 + 1) as p50_upper, median(value) as median from r group by all")
def latency_floor_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.percentile_floor(table(spark, sf_dir, "events"), "value", "event_type", 0.95)


@query("with c as (select o_orderstatus, count(*) as n_c from orders group by all) select o_orderstatus, n_c, round((select sum(n_c) from c) / ((select count(*) from c) * n_c)::double, 6) as weight from c")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.class_weights(table(spark, sf_dir, "orders"), "o_orderstatus")


# ---- logs -----------------------------------------------------------------------------------------------------------
@query("select user_id, arg_max(event_type, (ts, event_id)) as action, arg_max(value, (ts, event_id)) as value, count(*) as n_records from events group by all")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.latest_state(log(spark, sf_dir), "user_id", ["ts", "event_id"], ["action", "value"])


@query("select user_id, arg_max(event_type, (ts, event_id)) as action, arg_max(value, (ts, event_id)) as value, count(*) as n_records from events group by all")
def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    read = logs.read(spark, f"{sf_dir}/events.parquet*", schema).withColumnRenamed("event_type", "action")
    folder = f"{shared_dir(spark)}/latest-{uuid.uuid4().hex}"
    logs.drain(logs.latest(read, "user_id", ["ts", "event_id"], ["action", "value"]), f"{folder}/state", f"{folder}/checkpoint")
    return logs.current(spark, f"{folder}/state")


ENDS = ["purchase", "error"]
#: A time without a zone as microseconds, whatever the session's zone.
MICROS = "timestampdiff(microsecond, timestamp_ntz'1970-01-01 00:00:00', ts)"


@query("select user_id as job, coalesce(arg_min(event_type, (ts, event_id)) filter (where event_type in ('purchase', 'error')), arg_max(event_type, (ts, event_id))) as status, coalesce(arg_min(event_id, (ts, event_id)) filter (where event_type in ('purchase', 'error')), arg_max(event_id, (ts, event_id))) as seq, bool_or(event_type in ('purchase', 'error')) as ended, count(*) as n_records, 0::bigint as replays from events group by all")
def stream_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one stream of jobs, an event type as a job's status."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = logs.read(spark, f"{sf_dir}/events.parquet*", schema).selectExpr("user_id job", f"timestamp_micros({MICROS}) at", "event_id seq", "event_type status")
    folder = f"{shared_dir(spark)}/jobs-{uuid.uuid4().hex}"
    with state.stateful(spark):
        logs.drain(state.jobs(stream, ENDS, keep="60 days", late="60 days"), f"{folder}/state", f"{folder}/checkpoint")
    return logs.current(spark, f"{folder}/state", "job")


@query("with b as (select *, lag(event_type) over (partition by user_id order by ts, event_id) as p from events) select event_id, user_id, event_type as action from b where p is null or p <> event_type")
def idempotent_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.without_replays(log(spark, sf_dir), "user_id", ["ts", "event_id"], ["action"]).select("event_id", "user_id", "action")


@query("with b as (select event_type, lag(event_type) over (partition by user_id order by ts, event_id) as p from events) select p as from_state, event_type as to_state, count(*) as n from b where p is not null group by all")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.transitions(log(spark, sf_dir), "user_id", ["ts", "event_id"], "action")


@query("select doc_id, source from documents where lang <> 'en' qualify row_number() over (partition by source order by n_chars desc, doc_id) <= 3 union all select doc_id, source from documents where lang = 'en'")
def evidence_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("lang") == "en").alias("human"), (-F.col("n_chars")).alias("order"))
    return lifecycle.cap_per_group(docs, "source", ["order", "doc_id"], 3, "human").select("doc_id", "source")


@query("select l_partkey, arg_min(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) as l_orderkey from lineitem group by all")
def first_seen_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate")
    return lifecycle.first_seen(rows, "l_partkey", ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_partkey", "l_orderkey")


JOBS = "select user_id as job, coalesce(arg_min(event_type, (ts, event_id)) filter (where event_type in ('purchase', 'error')), arg_max(event_type, (ts, event_id))) as status, max((ts, event_id)) as o from events group by all"


@query(f"with j as ({JOBS}) select job, status from j where status not in ('purchase', 'error') union all (select job, status from j where status in ('purchase', 'error') order by o desc, job limit 128)")
def job_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = log(spark, sf_dir).withColumnsRenamed({"user_id": "job", "action": "status"})
    return lifecycle.admit_jobs(jobs, "job", ["ts", "event_id"], "status", ["purchase", "error"], 128)


RUNS = "select concat('run', user_id % 4) as run, user_id % 30 as case_id, case when event_type = 'error' then 'failed' else 'ok' end as status, event_type as output from events"
AGG = f"with c as (select run, case_id, count(*) as n, count(*) filter (where status = 'ok') as ok, count(distinct output) filter (where status = 'ok') as outputs from ({RUNS}) group by all), a as (select run, round(sum(ok) / sum(n)::double, 6) as valid_rate, round(avg(case when n >= 2 and outputs = 1 then 1 else 0 end), 6) as repeatability from c group by all)"


@query(AGG + " select * from a")
def run_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = log(spark, sf_dir).selectExpr("concat('run', user_id % 4) run", "user_id % 30 case_id", "case when action = 'error' then 'failed' else 'ok' end status", "action output")
    return lifecycle.run_aggregate(runs, 2)


@query(AGG + " select run, valid_rate from a where run <> 'run3' order by valid_rate desc, repeatability desc, run limit 1")
def select_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = run_aggregate(spark, sf_dir).withColumn("vetoed", F.col("run") == "run3")
    return lifecycle.select_winner(a, "vetoed", ["valid_rate", "repeatability"], "run").select("run", "valid_rate")


@query("with p as (select 0 as pool, p_partkey as id from part union all select 1, s_suppkey from supplier union all select 2, c_custkey from customer), r as (select *, row_number() over (partition by pool order by id) as turn from p) select pool::int as pool, id, row_number() over (order by turn, pool)::int as position from r qualify position <= 40")
def round_robin_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = [table(spark, sf_dir, t).select(F.col(c).alias("id")) for t, c in (("part", "p_partkey"), ("supplier", "s_suppkey"), ("customer", "c_custkey"))]
    return lifecycle.interleave(pools, "id", 40)


@query("with m as (select user_id as finding_id, event_id as evidence_id, row_number() over (partition by user_id order by ts, event_id) as rank, 0 as part, event_type from events where event_type <> 'signup'), s as (select finding_id, evidence_id, rank, part from m where event_type <> 'error' union all select user_id, event_id, 1, 1 from events where event_type = 'signup') select finding_id, concat('E', row_number() over (partition by finding_id order by part, rank, evidence_id)) as label, evidence_id, part::int as part from s")
def selected_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir).selectExpr("user_id finding_id", "event_id evidence_id", "ts", "action")
    machine = rows.where("action <> 'signup'").withColumn("rank", F.row_number().over(Window.partitionBy("finding_id").orderBy("ts", "evidence_id"))).select("finding_id", "evidence_id", "rank")
    return lifecycle.selected_evidence(machine, rows.where("action = 'error'").select("finding_id", "evidence_id"), rows.where("action = 'signup'").selectExpr("finding_id", "evidence_id", "1 rank"))


# ---- grounding ------------------------------------------------------------------------------------------------------
CASES = "select conv_id as case_id, string_agg(text, ' ' order by turn, text) as text from conversations where role = 'assistant' group by all"


@query(f"with c as ({CASES}), r as (select case_id, lower(text) as t from c) select case_id, round((contains(t, 'the')::int + contains(t, 'and')::int + contains(t, 'zu')::int) / 3.0::double, 6) as recall, (contains(t, 'idiot')::int + contains(t, 'der')::int)::bigint as forbidden_hits, contains(t, 'the') and contains(t, 'and') and contains(t, 'zu') and not contains(t, 'idiot') and not contains(t, 'der') as passed from r")
def grounding_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    cases = turns.groupBy(F.col("conv_id").alias("case_id")).agg(F.expr("listagg(text, ' ') within group (order by turn, text)").alias("text"))
    return audit.case_scores(cases.withColumns({"required": F.array(*map(F.lit, ("the", "and", "zu"))), "forbidden": F.array(*map(F.lit, ("Idiot", "der")))}))


@query("select conv_id, turn, len(list_distinct(regexp_extract_all(text, '[A-Z][\\p{L}]{5,}'))) as n_mentions, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Z][\\p{L}]{5,}'))), ' ') as mentions from conversations where len(regexp_extract_all(text, '[A-Z][\\p{L}]{5,}')) > 0")
def mention_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.mentions("text", r"[A-Z][\p{L}]{5,}").alias("m")).where(F.size("m") > 0)
    return found.select("conv_id", "turn", F.size("m").cast("long").alias("n_mentions"), F.array_join("m", " ").alias("mentions"))


@query("select conv_id, string_agg(role, '; ' order by turn, role) as roles, count(*) as n from conversations group by all")
def synonym_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.joined_text(table(spark, sf_dir, "conversations"), "conv_id", "role", "turn").withColumnRenamed("joined", "roles")


@query("select h as host, count(*) as n, h in ('localhost', '127.0.0.1') as loopback from (select regexp_extract(url, '^https?://([^/?#:]+)', 1) as h from pages) group by all")
def loopback_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select(T.host("url").alias("host"), T.is_loopback("url").alias("loopback"))
    return urls.groupBy("host", "loopback").agg(F.count("*").alias("n"))


# ---- audits, splits -------------------------------------------------------------------------------------------------
@query("select sha256(text) as sha, min(doc_id) as first_id, count(*) as n from documents group by sha256(text) having count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.content_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("with f as (select doc_id as id, min(doc_id) over (partition by sha256(text)) as first_id from documents) select id, first_id from f where id <> first_id")
def first_occurrence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.first_occurrence_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("select sha256(text) as sha, count(distinct source) as splits, count(*) as n from documents group by sha256(text) having count(distinct source) > 1")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.split_overlap(table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("sha")), "source", "sha")


@query("with r as (select doc_id as id, lang as stratum, row_number() over (partition by lang order by sha256(concat('seed', doc_id)), doc_id) as k, count(*) over (partition by lang) as n from documents) select id, stratum, case when k <= floor(n * 70 / 100.0::double) then 'train' when k <= floor(n * 70 / 100.0::double) + floor(n * 15 / 100.0::double) then 'val' else 'test' end as split from r")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_split(table(spark, sf_dir, "documents"), "doc_id", "lang")


@query("with f as (select doc_id as id from documents qualify row_number() over (partition by lang order by doc_id) <= 16), r as (select doc_id as id from documents where doc_id not in (select id from f) order by doc_id limit (select 128 - count(*) from f)) select id, 'class' as chosen_for from f union all select id, 'fill' from r")
def coverage_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.coverage_sample(table(spark, sf_dir, "documents"), "doc_id", "lang")


@query("select 'lineitem' as child, (select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 50 <> 0)) as n union all select 'customer', (select count(*) from customer where c_nationkey not in (select n_nationkey from nation where n_regionkey <> 2))")
def fk_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents are left out on purpose, so that there is something to find."""
    a = audit.orphans(table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey", table(spark, sf_dir, "orders").where("o_orderkey % 50 <> 0"), "o_orderkey")
    b = audit.orphans(table(spark, sf_dir, "customer").select("c_nationkey"), "c_nationkey", table(spark, sf_dir, "nation").where("n_regionkey <> 2"), "n_nationkey")
    return a.agg(F.count("*").alias("n")).selectExpr("'lineitem' child", "n").union(b.agg(F.count("*").alias("n")).selectExpr("'customer'", "n"))


@query("with z as (select count(*) as size from orders), c as (select case when l_orderkey % 11 = 0 then -l_orderkey else l_orderkey - 1 end as i, count(*) as n from lineitem group by all) select any_value(size) - count(*) filter (where i between 0 and size - 1) as missing, count(*) filter (where i between 0 and size - 1 and n > 1) as duplicated, count(*) filter (where i not between 0 and size - 1) as \"foreign\" from c, z")
def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order numbers of all lines against all orders; every eleventh is made foreign."""
    i = F.when(F.col("l_orderkey") % 11 == 0, -F.col("l_orderkey")).otherwise(F.col("l_orderkey") - 1)
    return audit.coverage(table(spark, sf_dir, "lineitem").select(i.alias("i")), "i", table(spark, sf_dir, "orders").count())


@query("with e as (select embedding::double[] as v from embeddings) select count(*) as n, count(*) filter (where len(v) <> 64) as wrong_width, count(*) filter (where len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) > 0) as not_finite, count(*) filter (where len(list_filter(v, lambda x: x <> 0)) = 0) as zero, count(*) filter (where abs(sqrt(list_dot_product(v, v)) - 1) > 0.00002) as not_unit, count(*) - count(distinct v) as repeated from e")
def embedding_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.embedding_quality(table(spark, sf_dir, "embeddings"), "embedding", 64)


@query("with t as (select o_orderpriority as category, o_orderkey, count(l_orderkey) as checks, count(*) filter (where l_returnflag = 'N') as ok from orders left join lineitem on l_orderkey = o_orderkey group by all) select category, count(*) as scenarios, round(sum(case when checks > 0 then ok / checks::double else 0 end), 4) as score from t group by all")
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    checks = lines.select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_returnflag") == "N").alias("ok"))
    return lifecycle.category_rollup(orders, checks, "o_orderkey", "o_orderpriority")


@query("select count(distinct (patch, truth)) filter (where truth > 0) as instances, count(*) filter (where truth > 0) as pixels, count(distinct patch) filter (where truth > 0) as patches, count(*) filter (where ignored) as void from (" + PX.partition("px as (")[2].partition(" from lineitem)")[0] + " from lineitem)")
def mask_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("truth") > 0
    return pixels(spark, sf_dir).agg(F.count_distinct(F.when(own, F.struct("patch", "truth"))).alias("instances"), F.count_if(own).alias("pixels"), F.count_distinct(F.when(own, F.col("patch"))).alias("patches"), F.count_if("ignored").alias("void"))


OBO = """format-version: 1.2
data-version: releases/2024-01-01

[Term]
id: GO:0000001
name: alpha cell
namespace: biological_process
alt_id: GO:0000009
def: "The \\"first\\" cell." [GOC:a, PMID:1]
synonym: "first cell" EXACT [GOC:a]
synonym: "one" RELATED []

[Term]
id: GO:0000002
name: beta cell
namespace: biological_process
is_a: GO:0000001 ! alpha cell
relationship: part_of GO:0000003 ! gamma

[Term]
id: GO:0000003
name: gamma
namespace: cellular_component
is_obsolete: true
replaced_by: GO:0000002

[Typedef]
id: part_of
name: part of
"""


@query()
def obo_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = ontology.fields(ontology.stanzas(spark.createDataFrame([(OBO,)], "value string")))
    t, s = ontology.terms(read), ontology.synonyms(read).groupBy("id").agg(F.count("*").alias("synonyms"))
    return t.join(s, "id", "left").join(ontology.edges(read).groupBy(F.col("child").alias("id")).agg(F.count("*").alias("parents")), "id", "left").fillna(0)


@query()
def logistic_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.logistic_head(table(spark, sf_dir, "embeddings"), "embedding", "label", (0.1, 1.0))


from quillon.plans import engine_queries  # noqa: E402, F401  adds its queries

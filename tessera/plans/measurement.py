"""Measurement queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as X
from tessera.operators import align as A
from tessera.operators import bootstrap as B
from tessera.operators import calibration, concepts, extraction, facets, grounding, structured
from tessera.plans import adapters as P

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


D = "CAST({} AS DOUBLE)"
RATIO = "CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"
F1 = "CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END"


def _ratio(a: str, b: str) -> str:
    return RATIO.format(a=a, b=b)


_CURVE = f"""
ans AS (SELECT conf, correct FROM al WHERE answered AND bucket IN ('pair', 'spurious', 'non_entity')),
ng AS (SELECT count(*) AS n_gold FROM al WHERE bucket IN ('pair', 'missed')),
th AS (SELECT DISTINCT conf AS threshold FROM ans),
cv AS (SELECT threshold, count(*) AS answered, count(*) FILTER (WHERE NOT correct) AS wrong FROM th JOIN ans ON ans.conf >= th.threshold GROUP BY threshold),
curve AS (SELECT threshold, {_ratio('answered', 'n_gold')} AS coverage, {_ratio('wrong', 'answered')} AS risk, answered, wrong, n_gold FROM cv, ng)
"""


@query(f"WITH {P.LINKS}, {_CURVE} SELECT * FROM curve")
def risk_coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.risk_coverage(P.links(spark, sf_dir)).drop("here", "here_wrong")


@query(f"""WITH {P.LINKS}, {_CURVE},
s AS (SELECT *, (coverage - lag(coverage) OVER (ORDER BY threshold DESC)) * (risk + lag(risk) OVER (ORDER BY threshold DESC)) / 2 AS area FROM curve)
SELECT round(coalesce(sum(area), 0), 9) AS aurc, coalesce(max(coverage) FILTER (WHERE risk <= 0.05), 0.0::DOUBLE) AS coverage_at_risk, count(*) AS points FROM s""")
def risk_coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grounding.curve_summary(grounding.risk_coverage(P.links(spark, sf_dir))), "aurc")


_PHI = """count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE bucket = 'pair' AND answered AND NOT correct) AS wrong_id, count(*) FILTER (WHERE bucket = 'pair' AND NOT answered) AS abstain,
count(*) FILTER (WHERE bucket = 'missed') AS missed, count(*) FILTER (WHERE bucket = 'spurious' AND answered) AS spurious_with_id, count(*) FILTER (WHERE bucket = 'non_entity' AND answered) AS non_entity_with_id"""


@query(f"""WITH {P.LINKS}, c AS (SELECT {_PHI} FROM al), m AS (SELECT *, correct + wrong_id + abstain + missed AS n FROM c)
SELECT *, {_ratio('correct - 10.0::DOUBLE * (wrong_id + spurious_with_id + non_entity_with_id)', 'n')} AS phi FROM m""")
def effective_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.effective_reliability(P.links(spark, sf_dir))


@query(f"""WITH {P.LINKS}, r AS (SELECT lower(trim(gold_authority)) AS authority, correct FROM al WHERE bucket = 'pair' AND has_id),
g AS (SELECT authority, count(*) AS n, count(*) FILTER (WHERE correct) AS correct FROM r GROUP BY authority UNION ALL SELECT NULL, count(*), count(*) FILTER (WHERE correct) FROM r)
SELECT authority, {_ratio('correct', 'n')} AS accuracy, n, correct FROM g""")
def disambiguation_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.disambiguation(P.links(spark, sf_dir))


@query(f"""WITH {P.LINKS}, e AS (SELECT gold_type AS type, correct::INT AS tp, 0 AS fp, (bucket IN ('pair', 'missed') AND has_id AND NOT correct)::INT AS fn FROM al UNION ALL SELECT pred_type, 0, (answered AND NOT correct)::INT, 0 FROM al),
t AS (SELECT u.type, coalesce(sum(tp), 0)::BIGINT AS tp, coalesce(sum(fp), 0)::BIGINT AS fp, coalesce(sum(fn), 0)::BIGINT AS fn FROM (SELECT unnest({P._T}) AS type) u LEFT JOIN e ON e.type = u.type GROUP BY u.type),
l AS (SELECT 'type' AS level, type, tp, fp, fn FROM t UNION ALL SELECT 'micro', NULL, sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM t),
q AS (SELECT *, {_ratio('tp', 'tp + fp')} AS p, {_ratio('tp', 'tp + fn')} AS r FROM l), f AS (SELECT *, {F1} AS f1 FROM q)
SELECT level, type, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1, tp, fp, fn FROM f
UNION ALL SELECT 'macro', NULL, round(avg(p), 9), round(avg(r), 9), round(avg(f1), 9), sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM f WHERE level = 'type'""")
def inkb_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grounding.inkb(P.links(spark, sf_dir)), "precision", "recall", "f1")


@query(f"""WITH {P.LINKS}, n AS (SELECT count(*) FILTER (WHERE NOT answered) AS predicted_nils, count(*) FILTER (WHERE gold_nil = 'NIL_NO_ID') AS gold_nils, count(*) FILTER (WHERE NOT answered AND gold_nil = 'NIL_NO_ID') AS correct_nils FROM al WHERE bucket = 'pair'),
q AS (SELECT *, {_ratio('correct_nils', 'predicted_nils')} AS p, {_ratio('correct_nils', 'gold_nils')} AS r FROM n)
SELECT p AS nil_precision, r AS nil_recall, round({F1}, 9) AS nil_f1, predicted_nils, gold_nils, correct_nils FROM q""")
def nil_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grounding.nil(P.links(spark, sf_dir)), "nil_f1")


@query(f"WITH {P.LINKS} SELECT item_id, conf, correct FROM al WHERE answered AND bucket IN ('pair', 'spurious', 'non_entity')")
def answered_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.answers(P.links(spark, sf_dir))


_CATS = """sch AS (SELECT unnest(['strict', 'exact', 'partial', 'type']) AS scheme),
ct AS (SELECT item_id, scheme, CASE WHEN bucket IN ('spurious', 'non_entity') THEN pred_type ELSE gold_type END AS type, CASE WHEN bucket IN ('spurious', 'non_entity') THEN 'SPU' WHEN bucket = 'missed' THEN 'MIS'
  WHEN scheme = 'type' THEN CASE WHEN same_type THEN 'COR' ELSE 'INC' END WHEN tier <> 'exact' THEN 'PAR' WHEN scheme = 'strict' AND NOT same_type THEN 'INC' ELSE 'COR' END AS cat FROM al, sch WHERE bucket <> 'trap_missed')"""
_FIVE = ", ".join(f"count(*) FILTER (WHERE cat = '{c}') AS {c}" for c in extraction.CATEGORIES)
_MUC = f"{_ratio('COR + 0.5::DOUBLE * PAR', 'COR + INC + PAR + SPU')} AS p, {_ratio('COR + 0.5::DOUBLE * PAR', 'COR + INC + PAR + MIS')} AS r"


@query(f"""WITH {P.LINKS}, {_CATS}, t AS (SELECT scheme, 'type' AS level, type, {_FIVE} FROM ct GROUP BY scheme, type UNION ALL SELECT scheme, 'micro', NULL, {_FIVE} FROM ct GROUP BY scheme),
q AS (SELECT *, {_MUC} FROM t), f AS (SELECT *, {F1} AS f FROM q)
SELECT scheme, level, type, COR, INC, PAR, MIS, SPU, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1 FROM f
UNION ALL SELECT scheme, 'macro', NULL, sum(COR)::BIGINT, sum(INC)::BIGINT, sum(PAR)::BIGINT, sum(MIS)::BIGINT, sum(SPU)::BIGINT, round(avg(p), 9), round(avg(r), 9), round(avg(f), 9) FROM f WHERE level = 'type' GROUP BY scheme""")
def extraction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(extraction.scores(P.links(spark, sf_dir)), "precision", "recall", "f1")


@query(f"WITH {P.LINKS}, {_CATS} SELECT item_id, {_FIVE} FROM ct WHERE scheme = 'strict' GROUP BY item_id")
def per_item_strict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.counts(extraction.categories(P.links(spark, sf_dir), ("strict",)), "item_id")


@query(f"WITH {P.LINKS} SELECT item_id, {_PHI} FROM al GROUP BY item_id")
def per_item_phi_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.phi_parts(P.links(spark, sf_dir), "item_id")


@query(f"WITH {P.LINKS} SELECT gold_type, {_PHI} FROM al GROUP BY gold_type")
def reliability_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.phi_parts(P.links(spark, sf_dir), "gold_type")


@query(f"WITH {P.LINKS}, {_CURVE} SELECT round(coalesce(avg(pow(conf - correct::INT, 2)), 0), 9) AS brier, count(*) AS n FROM ans")
def brier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.brier(grounding.answers(P.links(spark, sf_dir))), "brier")


@query(f"""WITH {P.LINKS}, {_CURVE}, b AS (SELECT least(greatest(CAST(floor(conf * 10) AS BIGINT), 0), 9) AS bin, * FROM ans), e AS (SELECT unnest(range(10)) AS bin)
SELECT e.bin, e.bin / CAST(10 AS DOUBLE) AS lo, (e.bin + 1) / CAST(10 AS DOUBLE) AS hi, count(conf) AS n, round(coalesce(avg(conf), 0), 9) AS mean_conf, round(coalesce(avg(correct::INT::DOUBLE), 0), 9) AS accuracy FROM e LEFT JOIN b ON b.bin = e.bin GROUP BY e.bin""")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.bins(grounding.answers(P.links(spark, sf_dir))), "mean_conf", "accuracy")


@query()
def smoothed_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed point of kernel smoothing; SQL has none."""
    return rounded(calibration.smece(grounding.answers(P.links(spark, sf_dir))), "smece")


_DRAWS = """nn AS (SELECT count(*) AS n FROM parts), num AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS slot FROM parts),
dr AS (SELECT b, (('0x' || substr(md5('0:' || CAST(b AS VARCHAR) || ':' || CAST(j AS VARCHAR)), 1, 8))::BIGINT) % n AS slot FROM nn, range({B}) rb(b), range(n) rj(j)),
"""


def _phi_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, n = grounding.phi_terms()
    return grounding.phi_parts(P.links(spark, sf_dir), "item_id").select("item_id", top.alias("top"), n.cast("double").alias("den"))


_PARTS = f"i AS (SELECT item_id, {_PHI} FROM al GROUP BY item_id), parts AS (SELECT item_id, correct - 10.0::DOUBLE * (wrong_id + spurious_with_id + non_entity_with_id) AS top, CAST(correct + wrong_id + abstain + missed AS DOUBLE) AS den FROM i)"


@query(f"""WITH {P.LINKS}, {_PARTS}, {_DRAWS.replace('{B}', '2000')} st AS (SELECT b, {_ratio('sum(top)', 'sum(den)')} AS s FROM dr JOIN num USING (slot) GROUP BY b)
SELECT round((SELECT {_ratio('sum(top)', 'sum(den)')} FROM parts), 9) AS point, round(quantile_cont(s, 0.025), 9) AS lo, round(quantile_cont(s, 0.975), 9) AS hi, (SELECT n FROM nn) AS n FROM st""")
def cluster_bootstrap_phi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.cluster_bootstrap(_phi_parts(spark, sf_dir), "item_id", ("top", "den"), X.ratio(F.col("top"), F.col("den"))), "point", "lo", "hi")


_PAIRED = "parts AS (SELECT item_id, count(*) FILTER (WHERE correct)::DOUBLE AS a, count(*) FILTER (WHERE correct AND conf >= 0.5)::DOUBLE AS c, count(*)::DOUBLE AS n0 FROM al GROUP BY item_id)"


@query(f"""WITH {P.LINKS}, {_PAIRED}, {_DRAWS.replace('{B}', '2000')} st AS (SELECT b, sum(a) / sum(n0) - sum(c) / sum(n0) AS d FROM dr JOIN num USING (slot) GROUP BY b)
SELECT round((SELECT sum(a) / sum(n0) - sum(c) / sum(n0) FROM parts), 9) AS delta, round(quantile_cont(d, 0.025), 9) AS lo, round(quantile_cont(d, 0.975), 9) AS hi,
round(least(1.0::DOUBLE, 2 * least((1 + count(*) FILTER (WHERE d <= 0)) / CAST(2001 AS DOUBLE), (1 + count(*) FILTER (WHERE d >= 0)) / CAST(2001 AS DOUBLE))), 9) AS p_value FROM st""")
def paired_bootstrap_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = P.links(spark, sf_dir).groupBy("item_id").agg(F.count_if("correct").cast("double").alias("a"), F.count_if(F.col("correct") & (F.col("conf") >= 0.5)).cast("double").alias("c"), F.count(F.lit(1)).cast("double").alias("n0"))
    return rounded(B.paired_bootstrap(parts, "item_id", ("a", "c", "n0"), F.col("a") / F.col("n0"), F.col("c") / F.col("n0")), "delta", "lo", "hi", "p_value")


_CONF = "cf AS (SELECT axis, g, p, count(*) AS n FROM fl GROUP BY axis, g, p)"
_VALUES = """v AS (SELECT DISTINCT axis, g AS value FROM fl UNION SELECT DISTINCT axis, p FROM fl WHERE p <> '__missing__'),
vc AS (SELECT v.axis, v.value, coalesce(sum(n) FILTER (WHERE g = value AND p = value), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (WHERE g <> value AND p = value), 0)::BIGINT AS fp, coalesce(sum(n) FILTER (WHERE g = value AND p <> value), 0)::BIGINT AS fn FROM v JOIN cf ON v.axis = cf.axis GROUP BY v.axis, v.value),
vq AS (SELECT *, {} AS p, {} AS r FROM vc), vf AS (SELECT axis, value, tp, fp, fn, {} AS f1 FROM vq)""".format(_ratio("tp", "tp + fp"), _ratio("tp", "tp + fn"), F1)
_KAPPA = """kt AS (SELECT axis, count(*) AS n, avg((g = p)::INT::DOUBLE) AS po FROM fl GROUP BY axis),
ka AS (SELECT axis, g AS v, count(*) AS a FROM fl GROUP BY axis, g), kb AS (SELECT axis, p AS v, count(*) AS b FROM fl GROUP BY axis, p),
kk AS (SELECT kt.axis, n, po, coalesce((SELECT sum(a * b)::DOUBLE FROM ka JOIN kb ON ka.axis = kb.axis AND ka.v = kb.v WHERE ka.axis = kt.axis), 0) / (CAST(n AS DOUBLE) * n) AS pe FROM kt),
kp AS (SELECT axis, n, CASE WHEN pe >= 1 THEN CASE WHEN po >= 1 THEN 1.0 ELSE 0.0 END ELSE (po - pe) / (1 - pe) END AS kappa FROM kk)"""


@query(f"WITH {P.FACET_LABELS}, {_CONF}, {_VALUES} SELECT axis, value, tp, fp, fn, round(f1, 9) AS f1 FROM vf")
def facet_value_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(facets.value_f1(facets.confusion(P.facet_labels(spark, sf_dir))), "f1")


@query(f"WITH {P.FACET_LABELS}, {_KAPPA} SELECT axis, n, round(kappa, 9) AS kappa FROM kp")
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(facets.kappa(facets.confusion(P.facet_labels(spark, sf_dir))), "kappa")


@query(f"""WITH {P.FACET_LABELS}, {_CONF}, {_VALUES}, {_KAPPA}, ax AS (SELECT unnest(['quality', 'toxic', 'unused']) AS axis), mf AS (SELECT axis, avg(f1) AS m FROM vf GROUP BY axis)
SELECT ax.axis, CASE WHEN n IS NULL THEN 'empty' ELSE 'scored' END AS status, coalesce(n, 0) AS n, round(m, 9) AS macro_f1, round(kappa, 9) AS kappa FROM ax LEFT JOIN kp ON kp.axis = ax.axis LEFT JOIN mf ON mf.axis = ax.axis""")
def facet_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = spark.createDataFrame([("quality",), ("toxic",), ("unused",)], "axis string")
    return rounded(facets.scores(P.facet_labels(spark, sf_dir), axes), "macro_f1", "kappa")


@query("SELECT CAST(l.doc_id AS VARCHAR) AS item_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.n_chars > 300)")
def unknown_prediction_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions whose item has no gold, ascending; gold are the longer documents."""
    gold = P.read(spark, sf_dir, "documents").where("n_chars > 300").select(F.col("doc_id").cast("string").alias("item_id"))
    return A.known_and_unknown(gold, P.read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("item_id")))[1]


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NOT NULL AS in_gold, l.doc_id IS NOT NULL AS in_pred
FROM (SELECT doc_id FROM documents WHERE n_chars > 300) d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id""")
def outer_item_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = P.read(spark, sf_dir, "documents").where("n_chars > 300")
    return A.outer_items(gold, P.read(spark, sf_dir, "labels"), "doc_id")


@query(f"WITH RECURSIVE {P.HIERARCHY} SELECT DISTINCT id, ancestor FROM up")
def hierarchy_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = P.hierarchy(spark, sf_dir)
    concepts.check_acyclic(edges)
    return concepts.ancestors(edges)


_CLOSED = """gc AS (SELECT item_id, concept_id AS concept FROM gold UNION SELECT item_id, ancestor FROM gold JOIN up ON up.id = concept_id),
tp AS (SELECT item_id, concept_id FROM ranked WHERE rank <= 5), pc AS (SELECT item_id, concept_id AS concept FROM tp UNION SELECT item_id, ancestor FROM tp JOIN up ON up.id = concept_id),
n AS (SELECT g.item_id, n_gold, coalesce(n_pred, 0) AS n_pred, coalesce(n_both, 0) AS n_both FROM (SELECT item_id, count(*) AS n_gold FROM gc GROUP BY 1) g LEFT JOIN (SELECT item_id, count(*) AS n_pred FROM pc GROUP BY 1) p ON p.item_id = g.item_id
  LEFT JOIN (SELECT gc.item_id, count(*) AS n_both FROM gc JOIN pc ON gc.item_id = pc.item_id AND gc.concept = pc.concept GROUP BY 1) b ON b.item_id = g.item_id)"""


@query(f"""WITH RECURSIVE {P.HIERARCHY}, {P.CONCEPTS}, {_CLOSED}, q AS (SELECT *, {_ratio('n_both', 'n_pred')} AS p, {_ratio('n_both', 'n_gold')} AS r FROM n), f AS (SELECT *, {F1} AS f FROM q),
s AS (SELECT {_ratio('sum(n_both)', 'sum(n_pred)')} AS p, {_ratio('sum(n_both)', 'sum(n_gold)')} AS r, avg(p) AS ap, avg(r) AS ar, avg(f) AS af, count(*) AS n_items FROM f)
SELECT round(p, 9) AS micro_precision, round(r, 9) AS micro_recall, round({F1}, 9) AS micro_f1, round(ap, 9) AS macro_precision, round(ar, 9) AS macro_recall, round(af, 9) AS macro_f1, n_items FROM s""")
def hierarchical_prf_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred = P.concept_ids(spark, sf_dir)
    out = concepts.hierarchical_prf(gold, concepts.rank(pred), concepts.ancestors(P.hierarchy(spark, sf_dir)), 5)
    return rounded(out, *[c for c in out.columns if c != "n_items"])


@query(f"WITH {P.CONCEPTS} SELECT item_id, concept_id, rank::INTEGER AS rank FROM ranked WHERE rank <= 5")
def top_5_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.rank(P.concept_ids(spark, sf_dir)[1]).where("rank <= 5")


@query(f"""WITH {P.CONCEPTS}, gs AS (SELECT DISTINCT item_id, concept_id FROM gold), gn AS (SELECT item_id, count(*) AS r FROM gs GROUP BY 1),
h AS (SELECT ranked.item_id, count(*) AS hits FROM ranked JOIN gs ON gs.item_id = ranked.item_id AND gs.concept_id = ranked.concept_id JOIN gn ON gn.item_id = ranked.item_id WHERE rank <= r GROUP BY 1)
SELECT round(avg(coalesce(hits, 0) / CAST(r AS DOUBLE)), 9) AS r_precision, count(*) AS n_items FROM gn LEFT JOIN h ON h.item_id = gn.item_id""")
def r_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred = P.concept_ids(spark, sf_dir)
    return rounded(concepts.r_precision(gold, concepts.rank(pred)), "r_precision")


@query(f"""WITH {P.CONCEPTS}, gs AS (SELECT DISTINCT item_id, concept_id FROM gold), t AS (SELECT DISTINCT item_id, concept_id FROM ranked WHERE rank <= 3),
e AS (SELECT gs.item_id, count(t.item_id) / CAST(count(*) AS DOUBLE) AS s FROM gs LEFT JOIN t ON t.item_id = gs.item_id AND t.concept_id = gs.concept_id GROUP BY 1) SELECT round(avg(s), 9) AS recall_at_k, count(*) AS n_items FROM e""")
def recall_at_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred = P.concept_ids(spark, sf_dir)
    return rounded(concepts.recall_at(gold, concepts.rank(pred), 3), "recall_at_k")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber AS g, rank() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate) AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem),
t AS (SELECT a.l_orderkey, sum(sign(a.g - b.g) * sign(a.p - b.p)) AS net, count(*) AS n0, count(*) FILTER (WHERE a.g = b.g) AS tg, count(*) FILTER (WHERE a.p = b.p) AS tp FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.i < b.i GROUP BY 1),
n AS (SELECT l_orderkey, count(*) AS n FROM s GROUP BY 1)
SELECT n.l_orderkey, n, round(coalesce(CASE WHEN (n0 - tg) * (n0 - tp) = 0 THEN NULL ELSE net / sqrt(CAST((n0 - tg) * (n0 - tp) AS DOUBLE)) END, 1), 9) AS tau FROM n LEFT JOIN t ON t.l_orderkey = n.l_orderkey""")
def step_order_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structured.kendall(P.step_pairs(spark, sf_dir), "l_orderkey"), "tau")


def _documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gold slots, predicted slots and gold documents: orders of a customer are documents of the type of their status."""
    o = P.read(spark, sf_dir, "orders")
    nth = F.row_number().over(Window.partitionBy("item_id", "type").orderBy("o_orderkey"))
    side = lambda keep, value: o.where(keep).select(F.col("o_custkey").cast("string").alias("item_id"), F.col("o_orderstatus").alias("type"), "o_orderkey", F.posexplode(F.array(*value)).alias("slot", "s")).withColumn("nth", F.dense_rank().over(Window.partitionBy("item_id", "type").orderBy("o_orderkey"))).select("item_id", "type", "nth", "slot", "s.name", "s.value")
    k = F.col("o_orderkey")
    slot = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    date, prio = F.md5(F.date_format("o_orderdate", "yyyy MM dd")), F.lower("o_orderpriority")
    gold = side(F.lit(True), [slot("date", date), slot("priority", prio)])
    pred = side(k % 5 != 0, [slot("date", F.when(k % 3 == 0, F.lit("none")).otherwise(date)), slot("priority", prio), slot("priority", F.lit("x"))])
    docs = o.select(F.col("o_custkey").cast("string").alias("item_id"), F.col("o_orderstatus").alias("type"), "o_orderkey").withColumn("nth", nth).select("item_id", "type", "nth")
    return gold, pred, docs


_SLOTS = """od AS (SELECT CAST(o_custkey AS VARCHAR) AS item_id, o_orderstatus AS type, o_orderkey AS k, md5(strftime(o_orderdate, '%Y %m %d')) AS d, lower(o_orderpriority) AS pr FROM orders),
gd AS (SELECT *, row_number() OVER (PARTITION BY item_id, type ORDER BY k) AS nth FROM od), pd AS (SELECT *, row_number() OVER (PARTITION BY item_id, type ORDER BY k) AS nth FROM od WHERE k % 5 <> 0),
m AS (SELECT g.item_id, g.type, g.nth, p.k IS NOT NULL AS matched, (p.k IS NOT NULL AND p.k % 3 <> 0 AND p.d = g.d)::INT + (p.k IS NOT NULL AND p.pr = g.pr)::INT AS correct FROM gd g LEFT JOIN pd p ON p.item_id = g.item_id AND p.type = g.type AND p.nth = g.nth)"""


@query(f"WITH {_SLOTS} SELECT item_id, type, nth::INTEGER AS nth, correct::BIGINT AS correct, 2::BIGINT AS total, correct / CAST(2 AS DOUBLE) AS accuracy, correct = 2 AS complete FROM m")
def document_field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred, docs = _documents(spark, sf_dir)
    return structured.field_accuracy(docs, structured.slot_hits(gold, pred))


@query(f"WITH {_SLOTS} SELECT type, count(*) AS docs, count(*) FILTER (WHERE matched) AS matched_docs, {_ratio('sum(correct)', '2 * count(*)')} AS field_accuracy, {_ratio('count(*) FILTER (WHERE correct = 2)', 'count(*)')} AS document_accuracy FROM m GROUP BY type")
def structured_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred, docs = _documents(spark, sf_dir)
    there = pred.select(*structured.KEY).distinct().withColumn("m", F.lit(1))
    rows = structured.field_accuracy(docs, structured.slot_hits(gold, pred)).join(there, structured.KEY, "left")
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("docs"), F.count("m").alias("matched_docs"), X.ratio(F.sum("correct"), F.sum("total")).alias("field_accuracy"), X.ratio(F.count_if("complete"), F.count(F.lit(1))).alias("document_accuracy"))


_ALIGNED = """SELECT CAST(l_orderkey AS VARCHAR) AS item_id, CASE WHEN l_partkey % 4 = 0 THEN 'missed' ELSE 'pair' END AS bucket, CASE WHEN l_partkey % 4 = 0 THEN 'none' WHEN l_partkey % 3 = 0 THEN 'fuzzy' ELSE 'exact' END AS tier, count(*) AS n
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3"""


@query(_ALIGNED)
def aligned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole alignment over names that are alike only where they are meant to be: digests of the part, some with a
    letter more, which are 98 % alike. No other two come near, so SQL can say what is matched."""
    parts = P.read(spark, sf_dir, "part").withColumn("p_name", F.md5(F.col("p_partkey").cast("string")))
    return A.align(*_part_mentions(parts, P.read(spark, sf_dir, "lineitem"))).groupBy("item_id", "bucket", "tier").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH m AS (SELECT sum(n) FILTER (WHERE tier = 'exact') AS e, sum(n) FILTER (WHERE tier = 'fuzzy') AS f, sum(n) FILTER (WHERE bucket = 'missed') AS x FROM ({_ALIGNED})), q AS (SELECT *, (e + 0.5::DOUBLE * f) / (e + f) AS p, (e + 0.5::DOUBLE * f) / (e + f + x) AS r FROM m)
SELECT (e + f + x)::BIGINT AS n_mentions, round({F1}, 9) AS strict_f1, CAST(e + f AS DOUBLE) / (e + f + x) AS phi, round(0.1::DOUBLE * 0.1, 9) AS brier FROM q""")
def scores_from_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and predicted records to headline numbers, as the scorecard has them: alignment, categories, reliability, calibration."""
    parts = P.read(spark, sf_dir, "part").withColumn("p_name", F.md5(F.col("p_partkey").cast("string")))
    al = A.align(*_part_mentions(parts, P.read(spark, sf_dir, "lineitem"))).cache()
    strict = extraction.scores(al).where("scheme = 'strict' and level = 'micro'").select(F.col("f1").alias("strict_f1"))
    phi = grounding.effective_reliability(al).select("phi")
    n = al.agg(F.count("g").alias("n_mentions"))
    return rounded(n.crossJoin(strict).crossJoin(phi).crossJoin(calibration.brier(grounding.answers(al)).select("brier")), "strict_f1", "brier")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 <> 0 AS has FROM orders), c AS (SELECT *, CASE WHEN has THEN 1 + (k % 3 <> 0)::INT ELSE 0 END AS correct FROM o)
SELECT sum(correct) / CAST(2 * count(*) AS DOUBLE) AS field_accuracy, count(*) FILTER (WHERE correct = 2) / CAST(count(*) AS DOUBLE) AS document_accuracy, avg(CASE WHEN k % 6 = 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) FILTER (WHERE has) AS step_recall,
  avg(CASE WHEN k % 6 <> 1 AND k % 4 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) FILTER (WHERE has) AS step_order, count(*) AS n_docs, count(*) FILTER (WHERE has) AS n_step_docs FROM c""")
def structured_from_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured scores from records: documents matched by type, slots by name, steps by optimal assignment and order."""
    k = F.col("o_orderkey")
    slot, step = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value")), lambda i, t: F.struct(F.lit(i).alias("order"), F.md5(F.concat(F.lit(t), k)).alias("text"))
    doc = lambda date, steps: F.struct(F.col("o_orderstatus").alias("schemaOrgType"), F.array(slot("date", date), slot("priority", F.lower("o_orderpriority"))).alias("slots"), steps.alias("steps"))
    o, date = P.read(spark, sf_dir, "orders"), F.md5(F.col("o_orderdate").cast("string"))
    steps = F.when(k % 6 == 1, F.array(step(1, "a"))).when(k % 4 == 1, F.array(step(1, "b"), step(2, "a"))).otherwise(F.array(step(1, "a"), step(2, "b")))
    gold = o.select(k.cast("string").alias("item_id"), F.array(doc(date, F.array(step(1, "a"), step(2, "b")))).alias("structured"))
    pred = o.select(k.cast("string").alias("item_id"), F.array_compact(F.array(F.when(k % 5 != 0, doc(F.when(k % 3 == 0, F.lit("none")).otherwise(date), steps)))).alias("structured"))
    return structured.structured_scores(gold, pred)


@query(f"""WITH m AS (SELECT p_partkey % 3 < 2 AS matched, p_partkey % 5 <> 0 AS h FROM part), n AS (SELECT count(*) FILTER (WHERE h AND matched) AS tp, count(*) FILTER (WHERE NOT h AND matched) AS fp, count(*) FILTER (WHERE h AND NOT matched) AS fn, count(*) FILTER (WHERE NOT h AND NOT matched) AS tn FROM m),
q AS (SELECT *, {_ratio('tp', 'tp + fp')} AS p, {_ratio('tp', 'tp + fn')} AS r FROM n) SELECT tp, fp, fn, tn, p AS precision, r AS recall, round({F1}, 9) AS f1 FROM q""")
def matcher_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matcher on pairs of digests that are equal, nearly equal or apart, against verdicts."""
    k = F.col("p_partkey")
    own = F.md5(k.cast("string"))
    other = F.when(k % 3 == 0, own).when(k % 3 == 1, F.concat(own, F.lit("s"))).otherwise(F.md5(F.concat(F.lit("x"), k)))
    pairs = P.read(spark, sf_dir, "part").select(F.struct(own.alias("surface"), F.array().cast("array<string>").alias("aliases")).alias("a"), F.struct(other.alias("surface")).alias("b"), (k % 5 != 0).alias("human_match"))
    return rounded(extraction.matcher_quality(A.bare_matches(pairs)), "f1")


@query()
def mention_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimal alignment of part names with misspelt ones, by order: every line of an order is a mention. Fuzzy similarity has no SQL."""
    return A.align(*_part_mentions(P.read(spark, sf_dir, "part"), P.read(spark, sf_dir, "lineitem"))).groupBy("item_id", "bucket", "tier").agg(F.count(F.lit(1)).alias("n"))


def _part_mentions(parts: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gold and predicted mentions of the parts of all lines."""
    part = parts.join(lines.select("l_orderkey", "l_linenumber", "l_partkey"), F.col("p_partkey") == F.col("l_partkey"))
    key = F.col("l_orderkey").cast("string")
    first = part.groupBy(key.alias("item_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_partkey", "p_name"))).alias("parts"))
    kind = lambda x: P._pick(("product", "book"), x["p_partkey"] % 2)
    gold = first.select("item_id", F.transform("parts", lambda x: F.struct(x["p_name"].alias("surface"), F.array().cast("array<string>").alias("aliases"), kind(x).alias("type"), F.lit(None).cast("string").alias("nil"), F.struct(F.lit("kb").alias("authority"), x["p_partkey"].cast("string").alias("id")).alias("gold_id"))).alias("mentions"))
    pred = first.select("item_id", F.transform(F.filter("parts", lambda x: x["p_partkey"] % 4 != 0), lambda x: F.struct(F.when(x["p_partkey"] % 3 == 0, F.concat(x["p_name"], F.lit("s"))).otherwise(x["p_name"]).alias("surface"), kind(x).alias("type"), F.struct(F.lit("kb").alias("authority"), x["p_partkey"].cast("string").alias("externalId"), F.lit(False).alias("nil"), F.lit(0.9).alias("grounding_confidence")).alias("grounding"))).alias("mentions"))
    return gold, pred

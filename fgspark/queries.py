"""Queries of the library over the test tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import tables as T
from .operators import conditioning as C
from .operators import energies as E
from .operators import grouped as G
from .operators import structure as S
from .plans import graphs as P

ORDER_COLUMNS, TRIANGLE, CHAIN = ["o_orderstatus", "o_orderpriority", "c_mktsegment"], [(0, 1), (1, 2), (0, 2)], [(0, 1), (1, 2)]


def _six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


def _orders(spark: SparkSession, d: str, scopes=TRIANGLE) -> tuple[DataFrame, DataFrame]:
    rows = P.table(spark, d, "orders").join(P.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return P.count_graph(rows, ORDER_COLUMNS, scopes)


def _lineitem(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return P.count_graph(P.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], [(0, 1), (0,), (1,)])


def sc_index_lineitem(spark: SparkSession, d: str) -> DataFrame:
    rows, cards = P.coded(P.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])
    size = F.array(*[F.lit(c) for c in cards])
    ei = T.index_of(F.array("v0", "v1"), T.strides(size))
    other = T.with_digit(F.col("ei"), F.lit(cards[0]), F.lit(cards[1]), F.lit(0))
    return rows.select(ei.alias("ei")).groupBy("ei").agg(F.count("*").alias("n")).select("ei", T.digit(F.col("ei"), F.lit(1), F.lit(cards[0])).alias("s0"), T.digit(F.col("ei"), F.lit(cards[0]), F.lit(cards[1])).alias("s1"), other.cast("bigint").alias("ei_with_first"), "n")


def fm_count_energies(spark: SparkSession, d: str) -> DataFrame:
    return _six(E.energy_rows(_orders(spark, d)[1]).drop("graph_id"), "energy")


def sc_log_sum_exp(spark: SparkSession, d: str) -> DataFrame:
    rows = P.table(spark, d, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1000).alias("x"))
    return _six(T.log_sum_exp(rows, ["l_returnflag"], "x", "lse"), "lse")


def in_exact_marginals(spark: SparkSession, d: str) -> DataFrame:
    variable, factor = _orders(spark, d)
    return _six(G.infer(G.packed(factor, variable), "bfexact").select("factor_id", "ei", "p", "log_z"), "p", "log_z")


def in_exact_map(spark: SparkSession, d: str) -> DataFrame:
    variable, factor = _orders(spark, d)
    return _six(G.infer(G.packed(factor, variable), "mapbfexact").select("var_id", "state", "energy"), "energy")


def in_bp_chain(spark: SparkSession, d: str) -> DataFrame:
    variable, factor = _orders(spark, d, CHAIN)
    return _six(G.infer(G.packed(factor, variable), "bp", tol=1e-10).select("factor_id", "ei", "p", "log_z"), "p", "log_z")


def in_tree_events(spark: SparkSession, d: str) -> DataFrame:
    """log Z of each user's chain, by forward messages folded over the user's events in order."""
    chains = P.event_chains(spark, d)
    card = P.EVENT_BANDS
    steps = P.transition_energies(chains, card)
    rows = F.array(*[F.array(*[F.lit(-steps[a + card * b]) for a in range(card)]) for b in range(card)])
    unary = lambda e, b: -e["value"] * (b + 1) / 100.0
    lse = lambda x: F.array_max(x) + F.log(F.aggregate(F.transform(x, lambda y: F.exp(y - F.array_max(x))), F.lit(0.0), lambda a, y: a + y))
    once = lambda value, use: F.transform(F.array(value), use)[0]

    def merge(alpha, e):
        moved = F.transform(rows, lambda row, b: once(F.zip_with(row, alpha, lambda t, a: t + a), lse) + unary(e, b))
        return F.when(F.size(alpha) == 0, F.transform(F.sequence(F.lit(0), F.lit(card - 1)), lambda b: unary(e, b))).otherwise(moved)

    listed = chains.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: F.struct(x["value"].alias("value"))).alias("e"))
    folded = F.aggregate("e", F.expr("cast(array() as array<double>)"), merge)
    return _six(listed.select("user_id", once(folded, lse).alias("log_z")), "log_z")


def in_tree_events_grouped(spark: SparkSession, d: str) -> DataFrame:
    variable, factor, types = P.event_graphs(spark, d)
    graphs = G.packed(E.energy_tables(factor, types), variable)
    return _six(G.log_z(graphs, "treeinf").select(F.col("graph_id").alias("user_id"), "log_z"), "log_z")


def in_map_events(spark: SparkSession, d: str) -> DataFrame:
    variable, factor, types = P.event_graphs(spark, d)
    graphs = G.packed(E.energy_tables(factor, types), variable)
    return _six(G.infer(graphs, "maptree").groupBy(F.col("graph_id").alias("user_id")).agg(F.max("energy").alias("energy")), "energy")


def ev_labeling_events(spark: SparkSession, d: str) -> DataFrame:
    variable, factor, types = P.event_graphs(spark, d)
    states = P.event_states(spark, d)
    energy = E.energy_rows(E.energy_tables(factor, types))
    return _six(E.labeling_energy(energy, E.scopes(factor, variable), states).select(F.col("graph_id").alias("user_id"), "energy"), "energy")


def ev_expected_orders(spark: SparkSession, d: str) -> DataFrame:
    variable, factor = _orders(spark, d)
    energy = E.energy_rows(factor)
    return _six(E.expected_energy(energy, G.infer(G.packed(factor, variable), "bfexact")).select("energy"), "energy")


def _sites(spark: SparkSession, d: str) -> DataFrame:
    """graph_id, var_id, s, logp: of each state of each event given the others, by softmax of the site's energies."""
    variable, factor, types = P.event_graphs(spark, d)
    sites = E.site_energies(E.energy_tables(factor, types), P.event_states(spark, d)).groupBy("graph_id", "var_id").agg(F.sort_array(F.collect_list(F.struct("s", (-F.col("energy")).alias("x")))).alias("c"))
    top = F.array_max(F.transform("c", lambda c: c["x"]))
    z = sites.withColumn("top", top).withColumn("z", F.col("top") + F.log(F.aggregate("c", F.lit(0.0), lambda a, c: a + F.exp(c["x"] - F.col("top")))))
    return z.select("graph_id", "var_id", F.explode(F.transform("c", lambda c: F.struct(c["s"].alias("s"), (c["x"] - F.col("z")).alias("logp")))).alias("c")).select("graph_id", "var_id", "c.s", "c.logp")


def ev_sites_events(spark: SparkSession, d: str) -> DataFrame:
    """Probability of each state of each event given the others."""
    return _six(_sites(spark, d).select(F.col("graph_id").alias("user_id"), F.col("var_id").alias("pos"), "s", F.exp("logp").alias("p")), "p")


def lk_pseudo_events(spark: SparkSession, d: str) -> DataFrame:
    """Negative log-pseudolikelihood of each chain, per variable."""
    own = _sites(spark, d).join(P.event_states(spark, d).withColumnRenamed("state", "s"), ["graph_id", "var_id", "s"])
    return _six(own.groupBy(F.col("graph_id").alias("user_id")).agg((-F.avg("logp")).alias("npl")), "npl")


def _embedding_energies(spark: SparkSession, d: str, kind: str) -> DataFrame:
    _, factor, types = P.embedding_graphs(spark, d, kind)
    return _six(E.energy_rows(E.energy_tables(factor, types)).select(F.col("graph_id").alias("vec_id"), F.col("ei").alias("s"), "energy"), "energy")


def fm_linear_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return _embedding_energies(spark, d, "linear")


def fm_tied_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return _embedding_energies(spark, d, "tied")


def fm_rbf_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return _embedding_energies(spark, d, "rbf")


def bm_observed_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Gradient of the labels' energies with respect to the linear weights."""
    _, factor, types = P.embedding_graphs(spark, d, "linear")
    seen = P.table(spark, d, "embeddings").select(F.col("vec_id").alias("graph_id"), F.lit(0).alias("factor_id"), F.col("label").cast("bigint").alias("ei"), F.lit(1.0).alias("p"))
    return E.weight_gradient(factor, seen, types).select("k", (F.round("g", 4) + F.lit(0.0)).alias("g"))


def lk_softmax_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Negative log-likelihood of each label under the linear factor."""
    variable, factor, types = P.embedding_graphs(spark, d, "linear")
    energy = E.energy_rows(E.energy_tables(factor, types)).withColumn("x", -F.col("energy"))
    z = T.log_sum_exp(energy, ["graph_id"], "x", "z")
    seen = P.table(spark, d, "embeddings").select(F.col("vec_id").alias("graph_id"), F.col("label").cast("bigint").alias("ei"))
    return _six(energy.join(seen, ["graph_id", "ei"]).join(z, "graph_id").select(F.col("graph_id").alias("vec_id"), (F.col("energy") + F.col("z")).alias("nll")), "nll")


def co_states_orders(spark: SparkSession, d: str) -> DataFrame:
    variable, factor = _orders(spark, d)
    seen = spark.createDataFrame([(0, 2, 1)], "graph_id bigint, var_id int, state int")
    return _six(C.condition_on_states(E.energy_rows(factor), E.scopes(factor, variable), seen).select("factor_id", "ei", "new_ei", "energy"), "energy")


def co_beliefs_orders(spark: SparkSession, d: str) -> DataFrame:
    variable, factor = _orders(spark, d)
    beliefs = spark.createDataFrame([(0, 2, s, p) for s, p in enumerate((0.0, 0.2, 0.55, 0.25))], "graph_id bigint, var_id int, s int, p double")
    return _six(C.condition_on_beliefs(E.energy_rows(factor), E.scopes(factor, variable), beliefs).select("factor_id", "new_ei", "energy"), "energy")


def st_adjacency_orders(spark: SparkSession, d: str) -> DataFrame:
    variable, factor = _orders(spark, d)
    return S.neighbours(E.scopes(factor, variable)).select("var_id", F.array_join("factors", ",").alias("factors"))


def _geography(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """One graph: customers hang on nations, nations on regions (variables 0.., 1000.., 2000..)."""
    nation, customer = P.table(spark, d, "nation"), P.table(spark, d, "customer")
    zero = F.lit(0).cast("bigint")
    up = nation.select(zero.alias("graph_id"), F.col("n_nationkey").cast("int").alias("factor_id"), F.array(F.col("n_regionkey").cast("int"), (F.col("n_nationkey") + 1000).cast("int")).alias("vars"))
    down = customer.select(zero.alias("graph_id"), (F.col("c_custkey") + 1000).cast("int").alias("factor_id"), F.array((F.col("c_nationkey") + 1000).cast("int"), (F.col("c_custkey") + 2000).cast("int")).alias("vars"))
    factor = up.unionByName(down)
    return factor.select("graph_id", F.explode("vars").alias("var_id")).distinct().withColumn("card", F.lit(2)), factor


def st_components_geography(spark: SparkSession, d: str) -> DataFrame:
    variable, factor = _geography(spark, d)
    return S.components(E.scopes(factor, variable), variable).select("var_id", "component")


def st_shape_geography(spark: SparkSession, d: str) -> DataFrame:
    variable, factor = _geography(spark, d)
    return S.shape(E.scopes(factor, variable), variable).drop("graph_id")


def io_ising(spark: SparkSession, d: str) -> DataFrame:
    _, factor = S.ising(spark, 16, 0.8)
    return factor.select("factor_id", F.col("vars")[0].alias("a"), F.col("vars")[1].alias("b"), F.posexplode("energies").alias("ei", "energy"))


def sc_total_correlation_labels(spark: SparkSession, d: str) -> DataFrame:
    """Mutual information of quality and toxicity under the labels' counts."""
    n = P.table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").cast("double").alias("n"))
    h = lambda *by: n.groupBy(*by).agg(F.sum("n").alias("n")).crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).agg(F.sum(-F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t"))).alias("h"))  # noqa: E731  sums of at most 4 rows
    one, two, both = h("quality").withColumnRenamed("h", "h1"), h("toxic").withColumnRenamed("h", "h2"), h("quality", "toxic")
    return _six(one.crossJoin(two).crossJoin(both).select((F.col("h1") + F.col("h2") - F.col("h")).alias("total_correlation")), "total_correlation")


def cube_labels(spark: SparkSession, d: str) -> DataFrame:
    return P.table(spark, d, "labels").cube("quality", "toxic").agg(F.count("*").alias("n"))


def ls_hamming_events(spark: SparkSession, d: str) -> DataFrame:
    """How many of a user's events differ in type from the one before."""
    from pyspark.sql import Window

    rows = P.event_chains(spark, d).withColumn("before", F.lag("state").over(Window.partitionBy("user_id").orderBy("pos")))
    return rows.groupBy("user_id").agg(F.sum(F.when(F.col("before").isNotNull() & (F.col("before") != F.col("state")), 1).otherwise(0)).alias("loss"))


def ln_statistics_events(spark: SparkSession, d: str) -> DataFrame:
    variable, factor, types = P.event_graphs(spark, d)
    v = variable.agg(F.count("*").alias("n_variables"), F.sum(F.log2("card")).alias("log2_states"))
    f = factor.agg(F.count("*").alias("n_factors"), F.sum(F.size("data")).alias("n_data"))
    w = types.agg(F.sum(F.size("w")).alias("n_parameters"))
    return _six(v.crossJoin(f).crossJoin(w), "log2_states")


def dv_kl_orders(spark: SparkSession, d: str) -> DataFrame:
    """KL divergence of the chain model from the triangle model (its third table 0 for the chain)."""
    variable, p = _orders(spark, d, TRIANGLE)
    q = p.withColumn("energies", F.when(F.col("factor_id") == 2, F.transform("energies", lambda e: F.lit(0.0))).otherwise(F.col("energies")))
    mp, mq = (G.infer(G.packed(x, variable), "bfexact") for x in (p, q))
    z = lambda m: m.groupBy("graph_id").agg(F.max("log_z").alias("log_z"))
    return _six(G.divergence(E.energy_rows(p), z(mp), E.energy_rows(q), z(mq), mq.drop("log_z")).select("kl"), "kl")


def dv_energy_statistic_labels(spark: SparkSession, d: str) -> DataFrame:
    """Energy statistic of the (quality, toxic) rows of all even and all odd documents, and its share of the distance between them."""
    rows = P.table(spark, d, "labels").select(F.lit(0).cast("bigint").alias("graph_id"), F.col("doc_id").alias("sample_id"), F.posexplode(F.array("quality", "toxic")).alias("var_id", "state"))
    return _six(G.energy_statistic(rows.where("sample_id % 2 = 0"), rows.where("sample_id % 2 <> 0")).select("statistic", "coefficient"), "statistic", "coefficient")


def io_fge_lines(spark: SparkSession, d: str) -> DataFrame:
    from .sources.fge import lines

    variable, factor = _lineitem(spark, d)
    return lines(factor, variable).select("text")


_EVENTS = """chains AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pos,
        CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS state, coalesce(value, 0.0) AS value FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
    st AS (SELECT CAST(range AS INTEGER) AS s FROM range(5)),
    seen AS (SELECT a, b, count(*) AS n FROM (SELECT state AS a, lead(state) OVER (PARTITION BY user_id ORDER BY pos) AS b FROM chains) WHERE b IS NOT NULL GROUP BY a, b),
    smooth AS (SELECT x.s AS a, y.s AS b, coalesce(n, 0) + 1 AS n FROM st x CROSS JOIN st y LEFT JOIN seen ON seen.a = x.s AND seen.b = y.s),
    trans AS (SELECT a, b, -ln(n::DOUBLE / sum(n) OVER (PARTITION BY a)) AS e FROM smooth)"""
_SITES = f"""WITH {_EVENTS},
    near AS (SELECT user_id, pos, state, value, lag(state) OVER w AS before, lead(state) OVER w AS after FROM chains WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
    cells AS (SELECT user_id, pos, state, s, -(value * (s + 1) / 100.0 + coalesce(t1.e, 0) + coalesce(t2.e, 0)) AS x FROM near CROSS JOIN st
        LEFT JOIN trans t1 ON t1.a = before AND t1.b = s LEFT JOIN trans t2 ON t2.a = s AND t2.b = after),
    lp AS (SELECT user_id, pos, state, s, x - top - ln(sum(exp(x - top)) OVER (PARTITION BY user_id, pos)) AS logp
        FROM (SELECT *, max(x) OVER (PARTITION BY user_id, pos) AS top FROM cells))"""
_FORWARD = f"""WITH RECURSIVE {_EVENTS},
    fw AS (SELECT user_id, 0 AS pos, s, -value * (s + 1) / 100.0 AS alpha FROM chains CROSS JOIN st WHERE pos = 0
        UNION ALL
        SELECT c.user_id, c.pos, st.s, MERGED - any_value(c.value) * (st.s + 1) / 100.0
        FROM fw JOIN chains c ON c.user_id = fw.user_id AND c.pos = fw.pos + 1 CROSS JOIN st JOIN trans ON trans.a = fw.s AND trans.b = st.s
        GROUP BY c.user_id, c.pos, st.s),
    ends AS (SELECT user_id, max(pos) AS pos FROM chains GROUP BY user_id)"""
_ORDERS = """base AS (SELECT CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS v0, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS v1,
        CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS v2 FROM orders JOIN customer ON o_custkey = c_custkey),
    d0 AS (SELECT DISTINCT v0 AS s FROM base), d1 AS (SELECT DISTINCT v1 AS s FROM base), d2 AS (SELECT DISTINCT v2 AS s FROM base),
    k AS (SELECT (SELECT count(*) FROM d0) AS c0, (SELECT count(*) FROM d1) AS c1, (SELECT count(*) FROM d2) AS c2),
    f0 AS (SELECT x.s AS a, y.s AS b, -ln(count(v0)::DOUBLE + 1) AS e FROM d0 x CROSS JOIN d1 y LEFT JOIN base ON v0 = x.s AND v1 = y.s GROUP BY ALL),
    f1 AS (SELECT x.s AS a, y.s AS b, -ln(count(v0)::DOUBLE + 1) AS e FROM d1 x CROSS JOIN d2 y LEFT JOIN base ON v1 = x.s AND v2 = y.s GROUP BY ALL),
    f2 AS (SELECT x.s AS a, y.s AS b, -ln(count(v0)::DOUBLE + 1) AS e FROM d0 x CROSS JOIN d2 y LEFT JOIN base ON v0 = x.s AND v2 = y.s GROUP BY ALL),
    cells AS (SELECT 0 AS factor_id, a + c0 * b AS ei, a, b, e FROM f0, k UNION ALL SELECT 1, a + c1 * b, a, b, e FROM f1, k UNION ALL SELECT 2, a + c0 * b, a, b, e FROM f2, k),
    joint AS (SELECT f0.a AS s0, f0.b AS s1, f1.b AS s2, f0.e + f1.e + f2.e AS e3, f0.e + f1.e AS e2 FROM f0 JOIN f1 ON f0.b = f1.a JOIN f2 ON f2.a = f0.a AND f2.b = f1.b)"""


def _marginals(energy: str, factors: tuple[int, ...]) -> str:
    index = {0: "s0 + c0 * s1", 1: "s1 + c1 * s2", 2: "s0 + c0 * s2"}
    parts = " UNION ALL ".join(f"SELECT {f} AS factor_id, CAST({index[f]} AS BIGINT) AS ei, p, z FROM q, k" for f in factors)
    return f"""WITH {_ORDERS}, z AS (SELECT max(-{energy}) + ln(sum(exp(-{energy} - (SELECT max(-{energy}) FROM joint)))) AS z FROM joint),
        q AS (SELECT s0, s1, s2, exp(-{energy} - z) AS p, z FROM joint, z)
        SELECT factor_id, ei, round(sum(p), 6) + 0.0 AS p, round(any_value(z), 6) + 0.0 AS log_z FROM ({parts}) GROUP BY factor_id, ei"""


_W = "(((7 * d + 13 * ENTRY) % 11 - 5) / 10.0)::DOUBLE"
_VECTORS = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL), st AS (SELECT CAST(range AS BIGINT) AS s FROM range(10)), x AS (SELECT vec_id, label, range AS d, v[range + 1] AS h FROM e, range(64))"

ORACLE_SQL = {
    "sc_index_lineitem": """WITH c AS (SELECT dense_rank() OVER (ORDER BY l_returnflag) - 1 AS s0, dense_rank() OVER (ORDER BY l_linestatus) - 1 AS s1 FROM lineitem), k AS (SELECT max(s0) + 1 AS c0 FROM c)
        SELECT CAST(s0 + c0 * s1 AS BIGINT) AS ei, CAST(s0 AS INTEGER) AS s0, CAST(s1 AS INTEGER) AS s1, CAST(s0 AS BIGINT) AS ei_with_first, count(*) AS n FROM c, k GROUP BY s0, s1, c0""",
    "fm_count_energies": f"WITH {_ORDERS} SELECT CAST(factor_id AS INTEGER) AS factor_id, CAST(ei AS BIGINT) AS ei, round(e, 6) + 0.0 AS energy FROM cells",
    "sc_log_sum_exp": "WITH x AS (SELECT l_returnflag, l_extendedprice / 1000 AS x, max(l_extendedprice / 1000) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) SELECT l_returnflag, round(max(m) + ln(sum(exp(x - m))), 6) + 0.0 AS lse FROM x GROUP BY 1",
    "in_exact_marginals": _marginals("e3", (0, 1, 2)),
    "in_bp_chain": _marginals("e2", (0, 1)),
    "in_exact_map": f"WITH {_ORDERS}, best AS (SELECT * FROM joint ORDER BY e3, s2, s1, s0 LIMIT 1) SELECT CAST(i AS INTEGER) AS var_id, CAST(CASE i WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END AS INTEGER) AS state, round(e3, 6) + 0.0 AS energy FROM best, (VALUES (0), (1), (2)) t(i)",
    "in_tree_events": _FORWARD.replace("MERGED", "(max(alpha - e) + ln(sum(exp(alpha - e - (SELECT max(f2.alpha) FROM fw f2 WHERE f2.user_id = c.user_id)))) + (SELECT max(f2.alpha) FROM fw f2 WHERE f2.user_id = c.user_id) - max(alpha - e))")
    + ", t AS (SELECT fw.user_id, alpha, max(alpha) OVER (PARTITION BY fw.user_id) AS m FROM fw JOIN ends ON ends.user_id = fw.user_id AND ends.pos = fw.pos) SELECT user_id, round(max(m) + ln(sum(exp(alpha - m))), 6) + 0.0 AS log_z FROM t GROUP BY user_id",
    "in_map_events": _FORWARD.replace("MERGED", "max(alpha - e)") + " SELECT fw.user_id, round(-max(alpha), 6) + 0.0 AS energy FROM fw JOIN ends ON ends.user_id = fw.user_id AND ends.pos = fw.pos GROUP BY fw.user_id",
    "ev_labeling_events": f"WITH {_EVENTS}, n AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY pos) AS before FROM chains) SELECT user_id, round(sum(value * (state + 1) / 100.0 + coalesce(e, 0)), 6) + 0.0 AS energy FROM n LEFT JOIN trans ON a = before AND b = state GROUP BY user_id",
    "ev_expected_orders": f"WITH {_ORDERS}, z AS (SELECT sum(exp(-e3 - (SELECT max(-e3) FROM joint))) AS z FROM joint) SELECT round(sum(exp(-e3 - (SELECT max(-e3) FROM joint)) / z * e3), 6) + 0.0 AS energy FROM joint, z",
    "ev_sites_events": _SITES + " SELECT user_id, pos, s, round(exp(logp), 6) + 0.0 AS p FROM lp",
    "lk_pseudo_events": _SITES + " SELECT user_id, round(-avg(logp), 6) + 0.0 AS npl FROM lp WHERE s = state GROUP BY user_id",
    "fm_linear_embeddings": f"WITH {_VECTORS} SELECT vec_id, s, round(sum(h * {_W.replace('ENTRY', 's')}), 6) + 0.0 AS energy FROM x, st GROUP BY vec_id, s",
    "fm_tied_embeddings": f"WITH {_VECTORS} SELECT vec_id, s, round(CASE WHEN s % 4 = 0 THEN 0 ELSE sum(h * {_W.replace('ENTRY', '(s % 4 - 1)')}) END, 6) + 0.0 AS energy FROM x, st GROUP BY vec_id, s",
    "fm_rbf_embeddings": f"WITH {_VECTORS}, b AS (SELECT vec_id, s, i, sum((h - (((7 * (d + i) + 13 * s) % 11 - 5) / 10.0)::DOUBLE / 5) ** 2) AS q FROM x, st, (VALUES (0), (1)) t(i) GROUP BY vec_id, s, i) SELECT vec_id, s, round(sum((1.0 + i)::DOUBLE * exp(-q)), 6) + 0.0 AS energy FROM b GROUP BY vec_id, s",
    "bm_observed_embeddings": f"WITH {_VECTORS} SELECT CAST(label * 64 + d AS BIGINT) AS k, round(sum(h), 4) + 0.0 AS g FROM x GROUP BY label, d",
    "lk_softmax_embeddings": f"WITH {_VECTORS}, n AS (SELECT vec_id, label, s, sum(h * {_W.replace('ENTRY', 's')}) AS e FROM x, st GROUP BY vec_id, label, s) SELECT vec_id, round(sum(CASE WHEN s = label THEN e END) + ln(sum(exp(-e))), 6) + 0.0 AS nll FROM n GROUP BY vec_id",
    "co_states_orders": f"WITH {_ORDERS} SELECT CAST(factor_id AS INTEGER) AS factor_id, CAST(ei AS BIGINT) AS ei, CAST(CASE factor_id WHEN 0 THEN ei ELSE a END AS BIGINT) AS new_ei, round(e, 6) + 0.0 AS energy FROM cells WHERE factor_id = 0 OR b = 1",
    "co_beliefs_orders": f"WITH {_ORDERS}, p(s, p) AS (VALUES (1, 0.2::DOUBLE), (2, 0.55), (3, 0.25)) SELECT CAST(factor_id AS INTEGER) AS factor_id, CAST(CASE factor_id WHEN 0 THEN ei ELSE a END AS BIGINT) AS new_ei, round(sum(CASE factor_id WHEN 0 THEN e ELSE e * coalesce(p, 0) END), 6) + 0.0 AS energy FROM cells LEFT JOIN p ON p.s = cells.b AND factor_id > 0 GROUP BY 1, 2",
    "st_adjacency_orders": "SELECT CAST(v AS INTEGER) AS var_id, f AS factors FROM (VALUES (0, '0,2'), (1, '0,1'), (2, '1,2')) t(v, f)",
    "st_components_geography": """WITH e AS (SELECT n_regionkey AS a, n_nationkey + 1000 AS b FROM nation UNION ALL SELECT c_nationkey + 1000, c_custkey + 2000 FROM customer),
        up AS (SELECT n_regionkey AS r, n_nationkey + 1000 AS v FROM nation UNION ALL SELECT n_regionkey, c_custkey + 2000 FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT n_regionkey, n_regionkey FROM nation)
        SELECT DISTINCT CAST(v AS INTEGER) AS var_id, CAST(r AS INTEGER) AS component FROM up""",
    "st_shape_geography": "SELECT count(DISTINCT n_regionkey) AS n_components, count(DISTINCT n_regionkey) = 1 AS is_connected, true AS is_forest, count(DISTINCT n_regionkey) = 1 AS is_tree FROM nation",
    "io_ising": "WITH i AS (SELECT CAST(range AS INTEGER) AS i FROM range(256)), f AS (SELECT i AS factor_id, (i + 255) % 256 AS a, i AS b FROM i UNION ALL SELECT i + 256, (i + 240) % 256, i FROM i) SELECT factor_id, a, b, CAST(ei AS INTEGER) AS ei, e::DOUBLE AS energy FROM f, (VALUES (0, -0.8), (1, 0.8), (2, 0.8), (3, -0.8)) t(ei, e)",
    "sc_total_correlation_labels": "WITH n AS (SELECT quality, toxic, count(*)::DOUBLE AS n FROM labels GROUP BY ALL), t AS (SELECT sum(n) AS t FROM n), h AS (SELECT sum(-n / t * ln(n / t)) AS h FROM n, t), h1 AS (SELECT sum(-m / t * ln(m / t)) AS h FROM (SELECT sum(n) AS m FROM n GROUP BY quality), t), h2 AS (SELECT sum(-m / t * ln(m / t)) AS h FROM (SELECT sum(n) AS m FROM n GROUP BY toxic), t) SELECT round(h1.h + h2.h - h.h, 6) + 0.0 AS total_correlation FROM h, h1, h2",
    "cube_labels": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY CUBE (quality, toxic)",
    "ls_hamming_events": f"WITH {_EVENTS}, n AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY pos) AS before FROM chains) SELECT user_id, CAST(sum(CASE WHEN before <> state THEN 1 ELSE 0 END) AS BIGINT) AS loss FROM n GROUP BY user_id",
    "ln_statistics_events": f"WITH {_EVENTS} SELECT count(*) AS n_variables, round(count(*) * log2(5), 6) + 0.0 AS log2_states, CAST(2 * count(*) - count(DISTINCT user_id) AS BIGINT) AS n_factors, count(*) AS n_data, CAST(30 AS BIGINT) AS n_parameters FROM chains",
    "dv_kl_orders": f"WITH {_ORDERS}, z AS (SELECT max(-e3) + ln(sum(exp(-e3 - (SELECT max(-e3) FROM joint)))) AS z3, max(-e2) + ln(sum(exp(-e2 - (SELECT max(-e2) FROM joint)))) AS z2 FROM joint) SELECT round(sum(exp(-e2 - z2) * (e3 - e2)) + any_value(z3) - any_value(z2), 6) + 0.0 AS kl FROM joint, z",
    "dv_energy_statistic_labels": "WITH p AS (SELECT quality, toxic, count(*)::DOUBLE AS n FROM labels WHERE doc_id % 2 = 0 GROUP BY ALL), q AS (SELECT quality, toxic, count(*)::DOUBLE AS n FROM labels WHERE doc_id % 2 <> 0 GROUP BY ALL), pq AS (SELECT sum(p.n * q.n * sqrt((p.quality <> q.quality)::INT + (p.toxic <> q.toxic)::INT)) / sum(p.n * q.n) AS m FROM p, q), pp AS (SELECT sum(p.n * q.n * sqrt((p.quality <> q.quality)::INT + (p.toxic <> q.toxic)::INT)) / sum(p.n * q.n) AS m FROM p, p q), qq AS (SELECT sum(p.n * q.n * sqrt((p.quality <> q.quality)::INT + (p.toxic <> q.toxic)::INT)) / sum(p.n * q.n) AS m FROM q p, q) SELECT round(2 * pq.m - pp.m - qq.m, 6) + 0.0 AS statistic, round((2 * pq.m - pp.m - qq.m) / (2 * pq.m), 6) + 0.0 AS coefficient FROM pq, pp, qq",
}
ORACLE_SQL["io_fge_lines"] = """WITH c AS (SELECT dense_rank() OVER (ORDER BY l_returnflag) - 1 AS a, dense_rank() OVER (ORDER BY l_linestatus) - 1 AS b FROM lineitem),
    k AS (SELECT max(a) + 1 AS ca, max(b) + 1 AS cb FROM c), va AS (SELECT DISTINCT a FROM c), vb AS (SELECT DISTINCT b FROM c),
    ab AS (SELECT va.a, vb.b, printf('%.10f', -ln(count(c.a)::DOUBLE + 1)) AS e FROM va CROSS JOIN vb LEFT JOIN c ON c.a = va.a AND c.b = vb.b GROUP BY ALL),
    ea AS (SELECT a, printf('%.10f', -ln(count(*)::DOUBLE + 1)) AS e FROM c GROUP BY a), eb AS (SELECT b, printf('%.10f', -ln(count(*)::DOUBLE + 1)) AS e FROM c GROUP BY b)
    SELECT concat_ws(chr(10), '2', ca || ' ' || cb, '3', '2 1 2', (SELECT string_agg(e, ' ' ORDER BY b, a) FROM ab), '1 1', (SELECT string_agg(e, ' ' ORDER BY a) FROM ea), '1 2', (SELECT string_agg(e, ' ' ORDER BY b) FROM eb), '') AS text FROM k"""
ORACLE_SQL["in_tree_events_grouped"] = ORACLE_SQL["in_tree_events"]

QUERIES = {
    f.__name__: f
    for f in (
        sc_index_lineitem, fm_count_energies, sc_log_sum_exp, in_exact_marginals, in_exact_map, in_bp_chain, in_tree_events, in_tree_events_grouped, in_map_events, ev_labeling_events,
        ev_expected_orders, ev_sites_events, lk_pseudo_events, fm_linear_embeddings, fm_tied_embeddings, fm_rbf_embeddings, bm_observed_embeddings, lk_softmax_embeddings, co_states_orders,
        co_beliefs_orders, st_adjacency_orders, st_components_geography, st_shape_geography, io_ising, sc_total_correlation_labels, cube_labels, ls_hamming_events, ln_statistics_events,
        dv_kl_orders, dv_energy_statistic_labels, io_fge_lines,
    )
}

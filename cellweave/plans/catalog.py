"""The queries over the driver's tables, each with its SQL counterpart where SQL can express
it. Doubles are rounded to six places on both sides; sets are lists joined in order."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import Move, Network
from ..functions import scalars
from ..operators import causality, chains, diagrams, graphs, kernels, local, runs, states, structure
from ..sources import spark as spark_sources
from ..sources.text import WRITERS
from . import api, derive
from .frames import Models, encode, kernel, state_text

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


#: From a0, m0, c and i.
_NETWORK_SQL = """m AS MATERIALIZED (SELECT model_id, tid, automaton, f, t, CAST(rate AS DOUBLE) AS rate, kind FROM m0),
a AS MATERIALIZED (SELECT *, CAST(coalesce(product(levels) OVER w, 1) AS BIGINT) AS stride, CAST(coalesce(product(levels + 1) OVER w, 1) AS BIGINT) AS stride1 FROM a0
  WINDOW w AS (PARTITION BY model_id ORDER BY automaton ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS MATERIALIZED (SELECT model_id, tid, automaton, f AS level, true AS own FROM m UNION ALL SELECT model_id, tid, automaton, level, false FROM c),
txt AS MATERIALIZED (SELECT m.model_id, m.tid, m.automaton || ': ' || m.f || ' -> ' || m.t || coalesce(' when ' || string_agg(c.automaton || '=' || c.level, ' and ' ORDER BY c.k), '') AS text FROM m LEFT JOIN c ON c.model_id = m.model_id AND c.tid = m.tid GROUP BY m.model_id, m.tid, m.automaton, m.f, m.t),
reg AS MATERIALIZED (SELECT DISTINCT m.model_id, c.automaton AS regulator, m.automaton FROM m JOIN c USING (model_id, tid) WHERE c.automaton <> m.automaton),
inf AS MATERIALIZED (SELECT model_id, src, dst, CASE WHEN min(s) = max(s) THEN min(s) ELSE 0 END AS sign FROM (SELECT m.model_id, c.automaton AS src, m.automaton AS dst, CASE WHEN (m.t >= m.f) = (c.level >= a.levels / 2.0) THEN 1 ELSE -1 END AS s FROM m JOIN c USING (model_id, tid) JOIN a ON a.model_id = m.model_id AND a.automaton = c.automaton WHERE c.automaton <> m.automaton) GROUP BY ALL)"""


# A network for each user, from the events: a (automata), m (transitions), c (conditions), i (initial), q (goals), g (guards).
FX = f"""WITH RECURSIVE pairs AS (SELECT user_id, event_type AS src, lead(event_type) OVER w AS dst FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
jn AS MATERIALIZED (SELECT 'u' || user_id AS model_id, src, dst, count(*) AS n FROM pairs WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL),
sd AS MATERIALIZED (SELECT x.model_id, x.dst AS automaton, x.src AS regulator, CASE WHEN x.n >= coalesce(y.n, 0) THEN 1 ELSE 0 END AS up FROM (SELECT *, row_number() OVER (PARTITION BY model_id, dst ORDER BY n DESC, src) AS k FROM jn WHERE src <> dst) x LEFT JOIN jn y ON y.model_id = x.model_id AND y.src = x.dst AND y.dst = x.src WHERE k = 1),
a0 AS MATERIALIZED (SELECT model_id, automaton, 2 AS levels FROM (SELECT model_id, src AS automaton FROM jn UNION SELECT model_id, dst FROM jn)),
sm0 AS MATERIALIZED (SELECT model_id, automaton, f, regulator, CASE WHEN f = 0 THEN up ELSE 1 - up END AS need, row_number() OVER (PARTITION BY model_id ORDER BY automaton, f) - 1 AS tid FROM sd, (SELECT unnest([0, 1]) AS f)),
m0 AS (SELECT model_id, tid, automaton, f, 1 - f AS t, 1.0 AS rate, 'exp' AS kind FROM sm0),
c AS MATERIALIZED (SELECT model_id, tid, 0 AS k, regulator AS automaton, need AS level FROM sm0),
i AS MATERIALIZED (SELECT a0.model_id, a0.automaton, CASE WHEN a0.automaton = b.begun THEN 1 ELSE 0 END AS level FROM a0 JOIN (SELECT 'u' || user_id AS model_id, arg_min(event_type, (ts, event_id)) AS begun FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL) b USING (model_id)),
{_NETWORK_SQL},
q AS MATERIALIZED (SELECT model_id || ' ' || automaton AS query_id, model_id, automaton, 1 AS level FROM a0 WHERE automaton IN ('purchase', 'error'))"""
#: The whole state graph: st (states), e (edges), s0 (starts), r (reachable states), name.
_GRAPH = """{fx},
size AS (SELECT model_id, CAST(product(levels) AS BIGINT) AS n FROM a GROUP BY model_id),
st AS MATERIALIZED (SELECT model_id, unnest(range(n)) AS sid FROM size),
e AS MATERIALIZED (SELECT st.model_id, st.sid, m.tid, m.rate, st.sid + (m.t - m.f) * o.stride AS dst FROM st JOIN m USING (model_id) JOIN a o ON o.model_id = m.model_id AND o.automaton = m.automaton
  WHERE NOT EXISTS (SELECT 1 FROM g JOIN a b ON b.model_id = g.model_id AND b.automaton = g.automaton WHERE g.model_id = st.model_id AND g.tid = m.tid AND (st.sid // b.stride) % b.levels <> g.level)),
s0 AS MATERIALIZED (SELECT st.model_id, st.sid FROM st WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.model_id = st.model_id AND EXISTS (SELECT 1 FROM i WHERE i.model_id = a.model_id AND i.automaton = a.automaton) AND NOT EXISTS (SELECT 1 FROM i WHERE i.model_id = a.model_id AND i.automaton = a.automaton AND i.level = (st.sid // a.stride) % a.levels))),
r AS (SELECT model_id, sid FROM s0 UNION SELECT e.model_id, e.dst FROM r JOIN e ON e.model_id = r.model_id AND e.sid = r.sid),
name AS MATERIALIZED (SELECT st.model_id, st.sid, string_agg(a.automaton || '=' || (st.sid // a.stride) % a.levels, ', ' ORDER BY a.automaton) AS state FROM st JOIN a USING (model_id) GROUP BY ALL)"""
GRAPH = _GRAPH.format(fx=FX)
def networks(spark, sf_dir) -> Models:
    """A Boolean network of event types for each user."""
    return derive.user_networks(spark.read.parquet(f"{sf_dir}/events.parquet"))


def goals(models: Models) -> DataFrame:
    """That a purchase gets active, and that an error does, in each network that has them."""
    asked = models.automata.where("automaton IN ('purchase', 'error')")
    return asked.select(F.concat_ws(" ", "model_id", "automaton").alias("query_id"), "model_id", "automaton", F.lit(1).alias("level"))


def goal_models(models: Models) -> DataFrame:
    """goals with their network's text, for kernels."""
    return goals(models).join(models.models.select("model_id", "text"), "model_id").select("query_id", "model_id", "automaton", "level", "text")


def _rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# Chains derived from events.

CHAIN = """pairs AS (SELECT user_id, event_type AS src, lead(event_type) OVER w AS dst, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
jumps AS MATERIALIZED (SELECT {model} AS model_id, src, dst, count(*) AS n, sum(us) AS us FROM pairs WHERE dst IS NOT NULL GROUP BY ALL),
edges AS MATERIALIZED (SELECT model_id, src, dst, n * 1e6 / stay AS rate FROM (SELECT *, sum(us) OVER (PARTITION BY model_id, src) AS stay FROM jumps) WHERE stay > 0),
p AS MATERIALIZED (SELECT *, rate / sum(rate) OVER (PARTITION BY model_id, src) AS p FROM edges)"""
ONE, EACH = CHAIN.format(model="'events'"), CHAIN.format(model="'u' || user_id")
MASS = """mass AS (SELECT DISTINCT model_id, src AS origin, src AS node, 1.0::DOUBLE AS m, 0 AS k FROM edges
  UNION ALL SELECT * FROM (SELECT mass.model_id, origin, p.dst, sum(m * p.p), k + 1 FROM mass JOIN p ON p.model_id = mass.model_id AND p.src = mass.node WHERE k < 300 AND node NOT IN ({ends}) GROUP BY mass.model_id, origin, p.dst, k))"""


def _chain(spark, sf_dir, per_user=False) -> DataFrame:
    return derive.event_chain(spark.read.parquet(f"{sf_dir}/events.parquet"), per_user)


def _purchase(edges: DataFrame, stop: bool = True) -> DataFrame:
    every = edges.select("model_id").distinct()
    node = lambda x: every.select("model_id", F.lit(x).alias("node"))
    return chains.absorption(edges, node("purchase"), node("error") if stop else None)


@query(f"""WITH RECURSIVE {ONE}, {MASS.format(ends="'purchase', 'error'")}
SELECT origin AS node, round(sum(m), 6) AS prob FROM mass WHERE node = 'purchase' GROUP BY origin UNION ALL SELECT 'error', 0.0 WHERE EXISTS (SELECT 1 FROM edges WHERE src = 'error' OR dst = 'error')""".replace("GROUP BY origin UNION", "AND origin <> 'error' GROUP BY origin UNION"))
def ctmc_reach_prob(spark, sf_dir):
    """Chance of a purchase before an error, by the event type one starts from."""
    return _purchase(_chain(spark, sf_dir)).select("node", F.round("prob", 6).alias("prob"))


@query(f"""WITH RECURSIVE {EACH}, {MASS.format(ends="'purchase', 'error'")},
nodes AS (SELECT model_id, src AS node FROM edges UNION SELECT model_id, dst FROM edges UNION SELECT model_id, 'purchase' FROM edges UNION SELECT model_id, 'error' FROM edges),
hit AS (SELECT model_id, origin, sum(m) AS prob FROM mass WHERE node = 'purchase' AND origin <> 'error' GROUP BY ALL)
SELECT n.model_id, n.node, round(CASE WHEN n.node = 'purchase' THEN 1.0 ELSE coalesce(prob, 0.0) END, 6) AS prob FROM nodes n LEFT JOIN hit ON hit.model_id = n.model_id AND hit.origin = n.node""")
def ctmc_reach_prob_per_user(spark, sf_dir):
    return _purchase(_chain(spark, sf_dir, True)).select("model_id", "node", F.round("prob", 6).alias("prob"))


@query(f"""WITH RECURSIVE {EACH}, {MASS.format(ends="'purchase', 'error'")},
nodes AS (SELECT model_id, src AS node FROM edges UNION SELECT model_id, dst FROM edges UNION SELECT model_id, 'purchase' FROM edges UNION SELECT model_id, 'error' FROM edges),
hit AS (SELECT model_id, origin, sum(m) AS prob FROM mass WHERE node = 'purchase' AND origin <> 'error' GROUP BY ALL)
SELECT n.model_id, n.node, round(CASE WHEN n.node = 'purchase' THEN 1.0 ELSE coalesce(prob, 0.0) END, 9) >= 0.5 AS meets_threshold FROM nodes n LEFT JOIN hit ON hit.model_id = n.model_id AND hit.origin = n.node""")
def threshold_decision(spark, sf_dir):
    return _purchase(_chain(spark, sf_dir, True)).select("model_id", "node", (F.round("prob", 9) >= 0.5).alias("meets_threshold"))


@query(f"""WITH RECURSIVE {ONE}, {MASS.format(ends="'purchase'")}, tau AS (SELECT src, 1 / sum(rate) AS tau FROM edges GROUP BY src)
SELECT origin AS node, round(sum(m * tau), 3) AS mean_time FROM mass JOIN tau ON tau.src = mass.node WHERE node <> 'purchase' AND origin <> 'purchase' GROUP BY origin UNION ALL SELECT 'purchase', 0.0""")
def expected_time(spark, sf_dir):
    """Mean seconds until a purchase, which is certain where nothing else ends a chain."""
    return _purchase(_chain(spark, sf_dir), stop=False).select("node", F.round("mean_time", 3).alias("mean_time"))


@query(f"WITH {EACH} SELECT model_id, src, dst, round(rate, 9) AS rate, round(p, 6) AS p FROM p")
def jump_chain(spark, sf_dir):
    return chains.jump_chain(_chain(spark, sf_dir, True)).select("model_id", "src", "dst", F.round("rate", 9).alias("rate"), F.round("p", 6).alias("p"))


@query(f"WITH {EACH} SELECT model_id, src, round(sum(rate), 9) AS exit_rate FROM edges GROUP BY ALL")
def exit_rates(spark, sf_dir):
    return chains.exit_rates(_chain(spark, sf_dir, True)).select("model_id", "src", F.round("exit_rate", 9).alias("exit_rate"))


@query(f"""WITH RECURSIVE {ONE}, {MASS.format(ends="'purchase'")} SELECT origin, node, round(sum(m), 6) AS mass FROM mass WHERE k = 4 OR (node = 'purchase' AND k < 4) GROUP BY ALL""")
def transient_mass(spark, sf_dir):
    """Where one is after four jumps; a purchase ends."""
    edges = _chain(spark, sf_dir)
    jumps = chains.jump_chain(edges.where("src <> 'purchase'"))
    start = edges.select("model_id", F.col("src").alias("origin"), F.col("src").alias("node")).distinct()
    return chains.transient_mass(jumps, start, 4).select("origin", "node", F.round("mass", 6).alias("mass"))


@query(ORACLES["ctmc_reach_prob"].replace("round(sum(m), 6)", "round(sum(m), 5)"))
def ctmc_by_joins(spark, sf_dir):
    """The same by rounds of joins, as for a chain beyond one task."""
    edges = _chain(spark, sf_dir).where("src <> 'error'")
    goal = edges.select("model_id", F.lit("purchase").alias("node")).distinct()
    return chains.absorption_by_joins(edges, goal).select("node", F.round("prob", 5).alias("prob"))


_COHORTS = """pairs AS (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events WHERE ts IS NOT NULL),
coh AS MATERIALIZED (SELECT 'c' || user_id % 16 AS model_id, src, dst, count(*) AS n FROM pairs WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL),
cp AS MATERIALIZED (SELECT model_id, src, dst, n / sum(n) OVER (PARTITION BY model_id, src) AS p FROM coh)"""


# Where exits are rare, which of two is taken goes by how often one is where each begins.
@query(f"""WITH RECURSIVE {_COHORTS}, mass AS (SELECT DISTINCT model_id, src AS node, 1.0::DOUBLE AS m, 0 AS k FROM cp UNION ALL SELECT * FROM (SELECT mass.model_id, cp.dst, sum(m * cp.p), k + 1 FROM mass JOIN cp ON cp.model_id = mass.model_id AND cp.src = mass.node WHERE k < 600 GROUP BY mass.model_id, cp.dst, k)),
ev AS (SELECT model_id, sum(m) FILTER (node = 'view') AS v, sum(m) FILTER (node = 'error') AS e FROM mass WHERE k = 600 GROUP BY model_id)
SELECT n.model_id, n.src AS node, round(v / (v + e), 6) AS prob FROM (SELECT DISTINCT model_id, src FROM cp) n JOIN ev USING (model_id)""")
def ctmc_rare_exit(spark, sf_dir):
    """Sixteen cohorts of users, whose chains go on for some 10^10 events until one ends at a view or at an error: the chance
    of the former."""
    n = derive.event_jumps(spark.read.parquet(f"{sf_dir}/events.parquet"), True).where("src IS NOT NULL")
    cohort = F.concat(F.lit("c"), (F.substring("model_id", 2, 20).cast("long") % 16).cast("string")).alias("model_id")
    jumps = n.groupBy(cohort, "src", "dst").agg(F.sum("n").cast("double").alias("rate"))
    exits = jumps.where("src IN ('view', 'error')").groupBy("model_id", "src").agg((F.sum("rate") * 1e-10).alias("rate"))
    edges = jumps.union(exits.select("model_id", "src", F.concat(F.lit("end at "), "src"), "rate"))
    goal = jumps.select("model_id", F.lit("end at view").alias("node")).distinct()
    found = chains.absorption(edges, goal).where("node NOT LIKE 'end at %'")
    return found.select("model_id", "node", F.round("prob", 6).alias("prob"))


# Structure.


@query(f"""{FX} SELECT model_id, count(*) AS automata, CAST(sum(levels) AS BIGINT) AS local_states, (SELECT count(*) FROM m WHERE m.model_id = a.model_id) AS transitions, count(*) FILTER (levels > 2) AS multivalued FROM a GROUP BY model_id""")
def model_info(spark, sf_dir):
    return structure.info(networks(spark, sf_dir))


@query(f"{FX} SELECT * FROM reg")
def regulators(spark, sf_dir):
    return structure.regulators(networks(spark, sf_dir))


@query(f"{FX} SELECT * FROM inf")
def interaction_graph(spark, sf_dir):
    return structure.influences(networks(spark, sf_dir))


@query(f"""{FX}, n AS (SELECT model_id, count(*) AS n FROM a GROUP BY ALL), cl AS (SELECT model_id, src, dst FROM inf UNION SELECT cl.model_id, cl.src, inf.dst FROM cl JOIN inf ON inf.model_id = cl.model_id AND inf.src = cl.dst),
comp AS (SELECT x.model_id, x.src, min(x.dst) AS comp FROM cl x JOIN cl y ON x.model_id = y.model_id AND x.src = y.dst AND x.dst = y.src GROUP BY ALL)
SELECT n.model_id, n.n AS automata, (SELECT CAST(sum(levels) AS BIGINT) FROM a WHERE a.model_id = n.model_id) AS local_states, (SELECT count(*) FROM m WHERE m.model_id = n.model_id) AS transitions,
 (SELECT count(*) FROM inf WHERE inf.model_id = n.model_id) AS edges, round((SELECT count(*) FROM inf WHERE inf.model_id = n.model_id) / CASE WHEN n.n > 1 THEN n.n * (n.n - 1) ELSE 1 END, 6) AS density,
 coalesce((SELECT max(k) FROM (SELECT count(*) AS k FROM inf WHERE inf.model_id = n.model_id GROUP BY dst)), 0) AS max_in_degree, coalesce((SELECT max(k) FROM (SELECT count(*) AS k FROM inf WHERE inf.model_id = n.model_id GROUP BY src)), 0) AS max_out_degree,
 (SELECT count(DISTINCT comp) FROM comp WHERE comp.model_id = n.model_id) AS feedback_components FROM n""")
def model_stats(spark, sf_dir):
    return structure.stats(networks(spark, sf_dir)).withColumn("density", F.round("density", 6))


_TRADE = """li AS (SELECT s_nationkey AS sn, c_nationkey AS cn, l_extendedprice AS x, l_discount AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey),
pr AS (SELECT sn, cn, round(sum(x), 2) AS revenue, sum(d) AS d, count(*) AS n FROM li GROUP BY ALL),
best AS (SELECT *, CASE WHEN round(d / n, 9) >= round(sum(d) OVER () / sum(n) OVER (), 9) THEN 1 ELSE -1 END AS sign, row_number() OVER (PARTITION BY sn ORDER BY revenue DESC, cn) AS rk FROM pr),
tr AS MATERIALIZED (SELECT 'trade' AS model_id, trim(a.n_name) AS src, trim(b.n_name) AS dst, sign, revenue FROM best JOIN nation a ON a.n_nationkey = sn JOIN nation b ON b.n_nationkey = cn WHERE rk <= {top})"""


def _trade(spark, sf_dir, top=2) -> DataFrame:
    t = {x: spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("lineitem", "orders", "customer", "supplier", "nation")}
    return derive.trade_graph(t["lineitem"], t["orders"], t["customer"], t["supplier"], t["nation"], top)


@query(f"WITH {_TRADE.format(top=2)} SELECT src, dst, sign, revenue FROM tr")
def trade_graph(spark, sf_dir):
    return _trade(spark, sf_dir).select("src", "dst", "sign", "revenue")


@query(f"""WITH RECURSIVE {_TRADE.format(top=2)}, cl AS (SELECT src, dst FROM tr UNION SELECT cl.src, tr.dst FROM cl JOIN tr ON tr.src = cl.dst),
mate AS (SELECT x.src, x.dst FROM cl x JOIN cl y ON x.src = y.dst AND x.dst = y.src), c AS (SELECT src, min(dst) AS comp FROM mate GROUP BY src)
SELECT 'trade' AS model_id, comp, string_agg(src, ',' ORDER BY src) AS nodes FROM c GROUP BY comp""")
def scc(spark, sf_dir):
    return structure.components(_trade(spark, sf_dir))


_CIRCUITS = """walk AS (SELECT model_id, src AS start, dst AS at, [src, dst] AS path, sign AS s FROM {g} WHERE dst > src
  UNION ALL SELECT walk.model_id, start, x.dst, list_append(path, x.dst), s * x.sign FROM walk JOIN {g} x ON x.model_id = walk.model_id AND x.src = walk.at WHERE x.dst > start AND NOT list_contains(path, x.dst)),
cyc AS (SELECT DISTINCT walk.model_id, list_aggregate(list_sort(path), 'string_agg', ',') AS nodes, CAST(s * x.sign AS INTEGER) AS sign FROM walk JOIN {g} x ON x.model_id = walk.model_id AND x.src = walk.at AND x.dst = walk.start)"""


@query(f"{FX}, {_CIRCUITS.format(g='inf')} SELECT * FROM cyc")
def circuits(spark, sf_dir):
    return structure.circuits(structure.influences(networks(spark, sf_dir))).select("model_id", "nodes", "sign")


@query(f"WITH RECURSIVE {_TRADE.format(top=2)}, {_CIRCUITS.format(g='tr')} SELECT model_id, count(*) AS total, count(*) FILTER (sign = 1) AS positive, count(*) FILTER (sign = -1) AS negative, false AS truncated FROM cyc GROUP BY model_id")
def feedback(spark, sf_dir):
    return structure.feedback(structure.circuits(_trade(spark, sf_dir)))


@query(f"WITH RECURSIVE {_TRADE.format(top=2)}, {_CIRCUITS.format(g='tr')} SELECT model_id, nodes, sign, false AS truncated FROM cyc")
def circuits_by_rounds(spark, sf_dir):
    return graphs.circuits(_trade(spark, sf_dir))


_CONE = "cone AS (SELECT query_id, model_id, automaton AS node FROM q UNION SELECT query_id, cone.model_id, regulator FROM cone JOIN reg ON reg.model_id = cone.model_id AND reg.automaton = cone.node)"


@query(f"{FX}, {_CONE} SELECT query_id, model_id, node FROM cone")
def cone(spark, sf_dir):
    return structure.cones(models := networks(spark, sf_dir), goals(models))


_PART = """SELECT DISTINCT k0.query_id, text FROM {cone} k0 JOIN m ON m.model_id = k0.model_id AND m.automaton = k0.node JOIN txt ON txt.model_id = m.model_id AND txt.tid = m.tid
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.model_id = m.model_id AND c.tid = m.tid AND c.automaton NOT IN (SELECT node FROM {cone} k1 WHERE k1.query_id = k0.query_id))"""


def _parts(models: Models, asked: DataFrame) -> DataFrame:
    """(query_id, text): for each of (query_id, model_id, automaton) the transitions of what the automaton depends on."""
    copy = lambda df: df.join(asked.select("query_id", "model_id"), "model_id").drop("model_id").withColumnRenamed("query_id", "model_id")
    each = Models(*(copy(x) for x in (models.automata, models.transitions, models.initial, models.models)))
    keep = structure.cones(models, asked).select(F.col("query_id").alias("model_id"), F.col("node").alias("automaton"))
    return structure.transition_texts(structure.restrict(each, keep)).select(F.col("model_id").alias("query_id"), "text")


@query(f"{FX}, {_CONE} {_PART.format(cone='cone')}")
def reduce(spark, sf_dir):
    """For every goal, its network without what the goal does not depend on."""
    return _parts(models := networks(spark, sf_dir), goals(models))


@query(f"{FX}, sl AS (SELECT model_id || ' ' || automaton AS query_id, model_id, automaton AS node FROM a UNION SELECT query_id, sl.model_id, regulator FROM sl JOIN reg ON reg.model_id = sl.model_id AND reg.automaton = sl.node) {_PART.format(cone='sl')}")
def slice(spark, sf_dir):
    """Every network cut down to what each of its automata depends on."""
    models = networks(spark, sf_dir)
    return _parts(models, models.automata.select(F.concat_ws(" ", "model_id", "automaton").alias("query_id"), "model_id", "automaton"))


@query(f"""{FX}, p AS MATERIALIZED (SELECT l || ' ' || r AS pair, l, r FROM (SELECT model_id AS l, lead(model_id) OVER (ORDER BY CAST(substr(model_id, 2) AS BIGINT)) AS r FROM (SELECT DISTINCT model_id FROM a)) WHERE r IS NOT NULL),
la AS (SELECT pair, automaton, levels FROM p JOIN a ON a.model_id = p.l), ra AS (SELECT pair, automaton, levels FROM p JOIN a ON a.model_id = p.r), lt AS (SELECT DISTINCT pair, text FROM p JOIN txt ON txt.model_id = p.l), rt AS (SELECT DISTINCT pair, text FROM p JOIN txt ON txt.model_id = p.r)
SELECT pair, 'only_left' AS change, automaton AS item FROM la ANTI JOIN ra USING (pair, automaton) UNION ALL SELECT pair, 'only_right', automaton FROM ra ANTI JOIN la USING (pair, automaton)
UNION ALL SELECT pair, 'levels', automaton || ': ' || la.levels || ' -> ' || ra.levels FROM la JOIN ra USING (pair, automaton) WHERE la.levels <> ra.levels
UNION ALL SELECT pair, 'added', text FROM rt ANTI JOIN lt USING (pair, text) UNION ALL SELECT pair, 'removed', text FROM lt ANTI JOIN rt USING (pair, text)""")
def model_diff(spark, sf_dir):
    """Each user's network against the next user's."""
    models = networks(spark, sf_dir)
    ids = models.models.select(F.col("model_id").alias("l"), F.substring("model_id", 2, 20).cast("long").alias("user"))
    # users in blocks, and the seams between them
    pairs = derive.consecutive(ids.withColumn("all", F.lit(0)), ["all"], F.expr("user div 1000"), ["user"], ["l"]).select(F.col("one.l").alias("l"), F.col("two.l").alias("r"))
    return structure.diff_pairs(models, pairs.withColumn("pair", F.concat_ws(" ", "l", "r")))


# The users' networks with a fault in most transitions, by their number, and an automaton without levels where the id is short.
_FLAWED = (
    FX.replace("SELECT model_id, automaton, 2 AS levels FROM (", "SELECT model_id, automaton, CASE WHEN automaton = 'view' AND length(model_id) = 2 THEN 0 ELSE 2 END AS levels FROM (")
    .replace("SELECT model_id, tid, automaton, f, 1 - f AS t, 1.0 AS rate", "SELECT model_id, tid, automaton, CASE tid % 8 WHEN 0 THEN 5 ELSE f END AS f, CASE tid % 8 WHEN 1 THEN -1 WHEN 6 THEN f ELSE 1 - f END AS t, 1.0 AS rate")
    .replace("SELECT model_id, tid, 0 AS k, regulator AS automaton, need AS level FROM sm0", "SELECT model_id, tid, 0 AS k, CASE tid % 8 WHEN 4 THEN 'x' ELSE regulator END AS automaton, CASE tid % 8 WHEN 5 THEN 9 ELSE need END AS level FROM sm0")
    + ",\nph AS MATERIALIZED (SELECT model_id, tid, CASE tid % 8 WHEN 2 THEN -1.0 ELSE 1.0 END AS r FROM m WHERE tid % 8 <> 3)"
)


def _flawed(models: Models) -> Models:
    by = lambda *pairs, other: F.when(F.col("tid") % 8 == pairs[0][0], pairs[0][1]).otherwise(other) if len(pairs) == 1 else F.when(F.col("tid") % 8 == pairs[0][0], pairs[0][1]).otherwise(by(*pairs[1:], other=other))
    law = lambda rates: F.struct(F.lit("phase").alias("kind"), F.size(rates).alias("phases"), rates.alias("rates"))
    condition = F.transform("conditions", lambda c: F.struct(by((4, F.lit("x")), other=c["automaton"]).alias("automaton"), by((5, F.lit(9)), other=c["level"]).alias("level")))
    t = models.transitions.select(
        "model_id", "tid", "automaton", by((0, F.lit(5)), other=F.col("from_level")).alias("from_level"), by((1, F.lit(-1)), (6, F.col("from_level")), other=F.col("to_level")).alias("to_level"),
        condition.alias("conditions"), by((2, law(F.array(F.lit(-1.0)))), (3, law(F.array().cast("array<double>"))), other=F.col("dist")).alias("dist"), "rate",
    )
    levels = F.when((F.col("automaton") == "view") & (F.length("model_id") == 2), 0).otherwise(F.col("levels"))
    return Models(models.automata.withColumn("levels", levels), t, models.initial, models.models)


@query(f"""{_FLAWED}, own AS (SELECT m.*, text, levels FROM m JOIN txt USING (model_id, tid) LEFT JOIN a USING (model_id, automaton))
SELECT model_id, 'error' AS severity, automaton || ': no level' AS message FROM a WHERE levels < 1
UNION ALL SELECT model_id, 'error', text || ': source level out of range' FROM own WHERE f >= levels OR f < 0
UNION ALL SELECT model_id, 'error', text || ': target level out of range' FROM own WHERE t >= levels OR t < 0
UNION ALL SELECT model_id, 'error', text || ': rate not positive' FROM own WHERE EXISTS (SELECT 1 FROM ph WHERE ph.model_id = own.model_id AND ph.tid = own.tid AND r <= 0)
UNION ALL SELECT model_id, 'error', text || ': no phase' FROM own WHERE NOT EXISTS (SELECT 1 FROM ph WHERE ph.model_id = own.model_id AND ph.tid = own.tid)
UNION ALL SELECT c.model_id, 'error', text || ': unknown automaton ' || c.automaton FROM c JOIN txt USING (model_id, tid) ANTI JOIN a ON a.model_id = c.model_id AND a.automaton = c.automaton
UNION ALL SELECT c.model_id, 'error', text || ': level of ' || c.automaton || ' out of range' FROM c JOIN txt USING (model_id, tid) JOIN a ON a.model_id = c.model_id AND a.automaton = c.automaton WHERE c.level >= a.levels OR c.level < 0
UNION ALL SELECT model_id, 'warning', automaton || ': no transition' FROM a ANTI JOIN m USING (model_id, automaton)
UNION ALL SELECT model_id, 'warning', text || ': stays where it is' FROM own WHERE f = t""")
def validate(spark, sf_dir):
    """The users' networks with every fault there is."""
    return structure.validate(_flawed(networks(spark, sf_dir)))


@query(f"""{FX}, law AS (SELECT model_id, tid, CASE kind WHEN 'erlang' THEN 'erlang(2, 4.0)' ELSE CAST(rate AS VARCHAR) END AS law FROM m)
SELECT model_id, '1' || automaton AS line, 'automaton ' || automaton || ' [' || list_aggregate(range(levels), 'string_agg', ', ') || ']' AS text FROM a
UNION ALL SELECT model_id, '2' || lpad(CAST(tid AS VARCHAR), 9, '0'), text || ' @ ' || law FROM txt JOIN law USING (model_id, tid)
UNION ALL SELECT model_id, '3', 'init ' || string_agg(automaton || '=' || level, ', ' ORDER BY automaton, level) FROM i GROUP BY model_id""")
def anx_render(spark, sf_dir):
    return structure.render_anx(networks(spark, sf_dir))


# The users' networks with laws of one, two and three phases in turn.
_PHASED = FX.replace("1.0 AS rate, 'exp' AS kind FROM sm0", "CASE (tid + length(automaton)) % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 2.0 ELSE 1 / 3.5 END AS rate, CASE (tid + length(automaton)) % 3 WHEN 0 THEN 'exp' WHEN 1 THEN 'erlang' ELSE 'phase' END AS kind FROM sm0")
_PHASED += ",\nph AS MATERIALIZED (SELECT model_id, tid, k, r::DOUBLE AS r FROM (SELECT model_id, tid, unnest(CASE kind WHEN 'exp' THEN [1.5] WHEN 'erlang' THEN [4.0, 4.0] ELSE [1.0, 2.0, 0.5] END) AS r, unnest(CASE kind WHEN 'exp' THEN [0] WHEN 'erlang' THEN [0, 1] ELSE [0, 1, 2] END) AS k FROM m))"


def _phased(models: Models) -> Models:
    law = lambda kind, rate, *rates: F.struct(F.struct(F.lit(kind).alias("kind"), F.lit(len(rates)).alias("phases"), F.array(*map(F.lit, rates)).alias("rates")).alias("dist"), F.lit(rate).alias("rate"))
    kind = (F.col("tid") + F.length("automaton")) % 3
    one = F.when(kind == 0, law("exp", 1.5, 1.5)).when(kind == 1, law("erlang", 2.0, 4.0, 4.0)).otherwise(law("phase", 1 / 3.5, 1.0, 2.0, 0.5))
    t = models.transitions.drop("dist", "rate").withColumn("law", one).select("*", "law.dist", "law.rate").drop("law")
    return Models(models.automata, t, models.initial, models.models)


@query(f"""{_PHASED}, n AS (SELECT model_id, tid, count(*) AS n FROM ph GROUP BY ALL),
b AS (SELECT m.*, a.levels + coalesce(sum(n - 1) OVER (PARTITION BY m.model_id, m.automaton ORDER BY m.tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, n FROM m JOIN n USING (model_id, tid) JOIN a USING (model_id, automaton))
SELECT model_id, CAST(row_number() OVER (PARTITION BY model_id ORDER BY tid, k) - 1 AS INTEGER) AS tid, automaton, CAST(CASE WHEN k = 0 THEN f ELSE base + k - 1 END AS INTEGER) AS from_level, CAST(CASE WHEN k = n - 1 THEN t ELSE base + k END AS INTEGER) AS to_level,
 CASE WHEN k = 0 THEN (SELECT count(*) FROM c WHERE c.model_id = b.model_id AND c.tid = b.tid) ELSE 0 END AS conditions, r AS rate FROM b JOIN ph USING (model_id, tid)""")
def expand_phase_type(spark, sf_dir):
    wide = structure.expand_phases(_phased(networks(spark, sf_dir)))
    return wide.transitions.select("model_id", "tid", "automaton", "from_level", "to_level", F.size("conditions").cast("long").alias("conditions"), "rate")


_ORDERS = """o AS (SELECT o_custkey AS c, o_orderstatus AS src, o_orderpriority AS pri, lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders),
mv AS MATERIALIZED (SELECT src, dst, pri, count(*) AS n FROM o WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL)"""


@query(f"WITH {_ORDERS} SELECT src, dst, pri, n, round(n / sum(n) OVER (PARTITION BY src), 6) AS share FROM mv")
def order_network(spark, sf_dir):
    """Guarded moves between order statuses: how often a customer's next order changes status, by priority."""
    moves = derive.order_moves(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return moves.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("src")), 6))


@query(f"{FX} SELECT model_id, tid, CAST(1 AS DOUBLE) AS rate, round(exp(ln(0.1) + CAST(('0x' || substr(md5('7|' || model_id || '|' || tid), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496 * (ln(5.0) - ln(0.1))), 6) AS drawn FROM m")
def assign_rates(spark, sf_dir):
    """Unit rates, and rates drawn between 0.1 and 5."""
    drawn = structure.assign_rates(networks(spark, sf_dir), 0.1, 5.0, 7).select("model_id", "tid", F.round("rate", 6).alias("drawn"))
    return structure.assign_rates(networks(spark, sf_dir)).select("model_id", "tid", "rate").join(drawn, ["model_id", "tid"])


@query(f"""{_PHASED}, x AS (SELECT model_id, automaton, sum(n - 1) AS more FROM (SELECT model_id, tid, count(*) AS n FROM ph GROUP BY ALL) JOIN m USING (model_id, tid) GROUP BY ALL HAVING sum(n - 1) > 0)
SELECT 'left' AS variant, model_id, 'levels' AS loss, string_agg(automaton, ', ' ORDER BY automaton) AS what FROM x GROUP BY model_id
UNION ALL SELECT DISTINCT 'left', model_id, 'rates', '' FROM ph WHERE r <> 1.0""")
def projection_losses(spark, sf_dir):
    """What is lost of the users' networks with expanded laws."""
    wide = structure.expand_phases(_phased(networks(spark, sf_dir)))
    return structure.projection_losses(wide).select(F.lit("left").alias("variant"), "model_id", "loss", "what")


_STEP = "WITH {t}, v AS (SELECT DISTINCT src AS node, length(src) / 10.0 AS value FROM tr), w AS (SELECT src, dst, revenue / 1e6 AS w FROM tr) SELECT dst AS node, {f} AS value FROM w JOIN v ON v.node = w.src GROUP BY dst"


def _semiring(kind: str, sql: str):
    def run(spark, sf_dir):
        tr = _trade(spark, sf_dir, 4)
        v = tr.select(F.col("src").alias("node"), (F.length("src") / 10).alias("value")).distinct()
        out = structure.semiring_step(tr.select("src", "dst", (F.col("revenue") / 1e6).alias("w")), v, kind)
        return out if kind == "bool" else out.withColumn("value", F.round("value", 6))

    run.__name__ = f"semiring_{kind}"
    query(_STEP.format(t=_TRADE.format(top=4), f=sql))(run)


for _kind, _f in (("tropical", "round(min(w + value), 6)"), ("viterbi", "round(max(w * value), 6)"), ("sum", "round(sum(w * value), 6)"), ("bool", "bool_or(w > 0 AND value > 0)")):
    _semiring(_kind, _f)


# State spaces.


@query(f"{GRAPH} SELECT e.model_id, n.state, e.tid, x.state AS next FROM e JOIN name n ON n.model_id = e.model_id AND n.sid = e.sid JOIN name x ON x.model_id = e.model_id AND x.sid = e.dst")
def state_successors(spark, sf_dir):
    spaces, transitions = encode(networks(spark, sf_dir))
    found = states.successors(states.all_states(spaces), transitions).join(spaces, "model_id")
    return found.select("model_id", state_text().alias("state"), "tid", state_text("dst").alias("next"))


@query(f"{GRAPH} SELECT model_id, state FROM r JOIN name USING (model_id, sid)")
def reachable_states(spark, sf_dir):
    models = networks(spark, sf_dir)
    return states.reachable(models).join(encode(models)[0], "model_id").select("model_id", state_text().alias("state"))


_FIX = "fx AS (SELECT model_id, sid FROM st EXCEPT SELECT model_id, sid FROM e)"


@query(f"{GRAPH}, {_FIX} SELECT model_id, state, false AS truncated FROM fx JOIN name USING (model_id, sid)")
def fixpoints(spark, sf_dir):
    return states.fixpoints(networks(spark, sf_dir))


@query(f"{GRAPH}, {_FIX} SELECT model_id, (SELECT count(*) FROM fx WHERE fx.model_id = size.model_id) AS fixpoints FROM size")
def fixpoint_count(spark, sf_dir):
    return states.fixpoint_counts(networks(spark, sf_dir)).withColumn("fixpoints", F.col("fixpoints").cast("long"))


_TRAP = f"""{FX}, size1 AS (SELECT model_id, CAST(product(levels + 1) AS BIGINT) AS n FROM a GROUP BY ALL), ps AS MATERIALIZED (SELECT model_id, unnest(range(n)) AS sid FROM size1),
gd AS MATERIALIZED (SELECT g.model_id, g.tid, g.level, g.own, a.stride1, a.levels FROM g JOIN a USING (model_id, automaton)),
bad AS MATERIALIZED (SELECT ps.model_id, ps.sid FROM ps JOIN gd ON gd.model_id = ps.model_id GROUP BY ps.model_id, ps.sid, gd.tid HAVING bool_and(CASE WHEN own THEN (ps.sid // stride1) % (levels + 1) = level + 1 ELSE (ps.sid // stride1) % (levels + 1) IN (0, level + 1) END)),
trap AS MATERIALIZED (SELECT model_id, sid FROM ps EXCEPT SELECT model_id, sid FROM bad),
dg AS MATERIALIZED (SELECT trap.model_id, sid, automaton, (sid // stride1) % (levels + 1) AS d FROM trap JOIN a USING (model_id)),
nm AS MATERIALIZED (SELECT model_id, sid, coalesce(string_agg(automaton || '=' || (d - 1), ', ' ORDER BY automaton) FILTER (d > 0), '') AS space FROM dg GROUP BY ALL)"""


@query(f"{_TRAP} SELECT model_id, space, false AS truncated FROM nm")
def trap_spaces(spark, sf_dir):
    return states.trap_spaces(networks(spark, sf_dir))


@query(f"""{_TRAP}, ins AS (SELECT p.model_id, p.sid AS outer_sid, x.sid AS inner_sid FROM dg p JOIN dg x ON p.model_id = x.model_id AND p.automaton = x.automaton AND p.sid <> x.sid GROUP BY ALL HAVING bool_and(p.d = 0 OR p.d = x.d))
SELECT model_id, space, false AS truncated FROM nm WHERE NOT EXISTS (SELECT 1 FROM ins WHERE ins.model_id = nm.model_id AND ins.outer_sid = nm.sid)""")
def trap_spaces_minimal(spark, sf_dir):
    return states.trap_spaces(networks(spark, sf_dir), minimal=True)


# What a state reaches shrinks along its runs; a state whose every successor reaches as much is in a terminal component.
@query(f"""{GRAPH}, cl AS (SELECT model_id, sid AS x, sid AS y FROM st UNION SELECT cl.model_id, x, e.dst FROM cl JOIN e ON e.model_id = cl.model_id AND e.sid = cl.y),
cn AS MATERIALIZED (SELECT model_id, x, min(y) AS low, count(*) AS n FROM cl GROUP BY ALL),
att AS MATERIALIZED (SELECT cl.model_id, cl.x, any_value(a.low) AS low, any_value(a.n) AS n FROM cl JOIN cn a ON a.model_id = cl.model_id AND a.x = cl.x JOIN cn b ON b.model_id = cl.model_id AND b.x = cl.y GROUP BY cl.model_id, cl.x HAVING bool_and(a.n = b.n))
SELECT att.model_id, n AS size, string_agg(state, ' | ' ORDER BY state) AS states, false AS truncated FROM att JOIN name ON name.model_id = att.model_id AND name.sid = att.x GROUP BY att.model_id, low, n""")
def attractors(spark, sf_dir):
    """Terminal components, one task a model."""
    return _attractors(networks(spark, sf_dir))


def _attractors(models: Models) -> DataFrame:
    found = api.attractors(models)
    return found.select("model_id", F.col("size").cast("long").alias("size"), F.array_join(F.array_sort("states"), " | ").alias("states"), "truncated")


# Local reachability and interventions.

_OA = """ls AS (SELECT model_id, automaton, unnest(range(levels)) AS level FROM a),
init AS (SELECT ls.* FROM ls WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.model_id = ls.model_id AND i.automaton = ls.automaton) UNION SELECT model_id, automaton, level FROM i),
bit AS MATERIALIZED (SELECT *, 1::BIGINT << (row_number() OVER (PARTITION BY model_id ORDER BY automaton, level) - 1)::INTEGER AS bit FROM ls),
mask0 AS MATERIALIZED (SELECT model_id, bit_or(bit) AS seed FROM init JOIN bit USING (model_id, automaton, level) GROUP BY ALL),
rule AS MATERIALIZED (SELECT m.model_id, m.tid, m.automaton, any_value(tb.bit) AS target, bit_or(bit.bit) AS need FROM m JOIN g USING (model_id, tid) JOIN bit ON bit.model_id = g.model_id AND bit.automaton = g.automaton AND bit.level = g.level JOIN bit tb ON tb.model_id = m.model_id AND tb.automaton = m.automaton AND tb.level = m.t GROUP BY ALL)"""
_GROW = "grow AS (SELECT {key}, model_id, {seed} AS mask, 0 AS k FROM {base} UNION ALL SELECT {gk}, grow.model_id, grow.mask | coalesce((SELECT bit_or(target) FROM rule WHERE rule.model_id = grow.model_id AND (grow.mask & need) = need {but}), 0) {free}, k + 1 FROM grow {join} WHERE k < 25)"
#: The goals that are possible at all; the others have no cut sets, and no mutation disables them.
_CAN = f""", {_GROW.format(key='model_id AS mid', seed='seed', base='mask0', gk='mid', but='', free='', join='').replace('grow', 'grow0')}, can AS MATERIALIZED (SELECT gb.query_id FROM gb JOIN grow0 ON grow0.model_id = gb.model_id AND k = 25 AND (grow0.mask & goal) <> 0)"""


@query(f"{FX}, {_OA}, {_GROW.format(key='model_id AS mid', seed='seed', base='mask0', gk='mid', but='', free='', join='')} SELECT grow.model_id, automaton, level::INTEGER AS level FROM grow JOIN bit ON bit.model_id = grow.model_id AND (bit.bit & mask) <> 0 WHERE k = 25")
def may_reach(spark, sf_dir):
    return local.may_reach(networks(spark, sf_dir)).drop("variant")


@query(f"""{FX}, {_OA}, base AS (SELECT b.model_id, b.automaton || '=' || b.level AS variant, seed & ~b.bit AS seed, b.bit AS blk FROM bit b JOIN mask0 USING (model_id)),
grow AS (SELECT model_id, variant, seed AS mask, blk, 0 AS k FROM base UNION ALL SELECT grow.model_id, variant, grow.mask | (coalesce((SELECT bit_or(target) FROM rule WHERE rule.model_id = grow.model_id AND (grow.mask & need) = need), 0) & ~blk), blk, k + 1 FROM grow WHERE k < 25)
SELECT grow.model_id, variant, automaton, level::INTEGER AS level FROM grow JOIN bit ON bit.model_id = grow.model_id AND (bit.bit & mask) <> 0 WHERE k = 25""")
def may_reach_blocked(spark, sf_dir):
    """Every local state blocked in turn, all variants in one job."""
    models = networks(spark, sf_dir)
    each = models.automata.select("model_id", "automaton", F.explode(F.sequence(F.lit(0), F.col("levels") - 1)).alias("level"))
    return local.may_reach(models, each.withColumn("variant", F.format_string("%s=%d", "automaton", "level")))


@query(f"""{FX}, {_OA}, gb AS (SELECT query_id, q.model_id, bit AS goal FROM q JOIN bit USING (model_id, automaton, level)){_CAN},
base AS (SELECT query_id, gb.model_id, b.automaton || '=' || b.level AS member, seed AS mask, b.bit AS blk, goal FROM gb JOIN mask0 USING (model_id) JOIN bit b ON b.model_id = gb.model_id WHERE (b.bit & seed) = 0 AND b.bit <> goal),
grow AS (SELECT *, 0 AS k FROM base UNION ALL SELECT query_id, grow.model_id, member, grow.mask | (coalesce((SELECT bit_or(target) FROM rule WHERE rule.model_id = grow.model_id AND (grow.mask & need) = need), 0) & ~blk), blk, goal, k + 1 FROM grow WHERE k < 25)
SELECT query_id, member FROM grow SEMI JOIN can USING (query_id) WHERE k = 25 AND (mask & goal) = 0""")
def cutsets_single(spark, sf_dir):
    return local.single_cutsets(models := networks(spark, sf_dir), goals(models))


@query(f"""{FX}, {_OA}, gb AS (SELECT query_id, q.model_id, bit AS goal FROM q JOIN bit USING (model_id, automaton, level)){_CAN}, whole AS (SELECT model_id, automaton, bit_or(bit) AS own FROM bit GROUP BY ALL),
base AS (SELECT query_id, gb.model_id, b.automaton AS frozen, b.automaton || '=' || b.level AS target, (seed & ~own) | b.bit AS mask, goal FROM gb JOIN mask0 USING (model_id) JOIN bit b ON b.model_id = gb.model_id JOIN whole w ON w.model_id = b.model_id AND w.automaton = b.automaton),
grow AS (SELECT *, 0 AS k FROM base UNION ALL SELECT query_id, grow.model_id, frozen, target, grow.mask | coalesce((SELECT bit_or(rule.target) FROM rule WHERE rule.model_id = grow.model_id AND rule.automaton <> grow.frozen AND (grow.mask & need) = need), 0), goal, k + 1 FROM grow WHERE k < 25)
SELECT query_id, target FROM grow SEMI JOIN can USING (query_id) WHERE k = 25 AND (mask & goal) = 0""")
def mutations_disabling(spark, sf_dir):
    return local.disabling_mutations(models := networks(spark, sf_dir), goals(models))


@query(f"""{FX}, lp AS (SELECT model_id, automaton, f AS source, t AS target, [tid] AS path, [f, t] AS seen FROM m WHERE f <> t UNION ALL SELECT lp.model_id, lp.automaton, source, m.t, list_append(path, m.tid), list_append(seen, m.t) FROM lp JOIN m ON m.model_id = lp.model_id AND m.automaton = lp.automaton AND m.f = lp.target WHERE NOT list_contains(seen, m.t))
SELECT model_id, automaton, source, target, list_aggregate(path, 'string_agg', ',') AS path FROM lp""")
def local_paths(spark, sf_dir):
    return local.local_paths(networks(spark, sf_dir)).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ","))


# Questions about goals, one task a goal.


def _ask(spark, sf_dir, schema: str, answer) -> DataFrame:
    return kernel(goal_models(networks(spark, sf_dir)), schema, lambda net, q: answer(net, net.initial, (q["automaton"], int(q["level"])), q["query_id"]))


_HIT = """hits AS MATERIALIZED (SELECT query_id, st.model_id, st.sid FROM q JOIN a USING (model_id, automaton) JOIN st ON st.model_id = q.model_id WHERE (st.sid // stride) % levels = level)"""


@query(f"""{GRAPH}, {_HIT}, {_OA}, {_GROW.format(key='model_id AS mid', seed='seed', base='mask0', gk='mid', but='', free='', join='')},
oa AS (SELECT query_id, (mask & bit) <> 0 AS oa FROM q JOIN bit USING (model_id, automaton, level) JOIN grow ON grow.model_id = q.model_id AND k = 25), ua AS (SELECT q.query_id, EXISTS (SELECT 1 FROM hits JOIN r USING (model_id, sid) WHERE hits.query_id = q.query_id) AS ua FROM q)
SELECT query_id, oa, ua, CASE WHEN ua THEN 'Reachable' WHEN oa THEN 'Inconclusive' ELSE 'Unreachable' END AS verdict FROM oa JOIN ua USING (query_id)""")
def reachability(spark, sf_dir):
    return _ask(spark, sf_dir, "query_id string, oa boolean, ua boolean, verdict string", lambda net, ctx, goal, i: [(i, *(kernels.reachability(net, ctx, goal)[k] for k in ("oa", "ua", "verdict")))])


@query(f"{GRAPH}, {_HIT} SELECT q.query_id, EXISTS (SELECT 1 FROM hits JOIN r USING (model_id, sid) WHERE hits.query_id = q.query_id) AS reachable, (SELECT count(*) FROM r WHERE r.model_id = q.model_id) AS reachable_states FROM q")
def symbolic_reachability(spark, sf_dir):
    return states.symbolic_reachability(models := networks(spark, sf_dir), goals(models)).withColumn("reachable_states", F.col("reachable_states").cast("long"))


_PROB = f"""{GRAPH}, {_HIT}, ex AS MATERIALIZED (SELECT model_id, sid, sum(rate) AS out FROM e GROUP BY ALL), jp AS MATERIALIZED (SELECT e.model_id, e.sid, e.dst, sum(e.rate / ex.out) AS p FROM e JOIN ex USING (model_id, sid) GROUP BY ALL),
go AS MATERIALIZED (SELECT q.query_id, jp.* FROM q JOIN jp USING (model_id) WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = q.query_id AND h.sid = jp.sid)),
ms AS (SELECT q.query_id, q.model_id, s0.sid, 1.0::DOUBLE / (SELECT count(*) FROM s0 z WHERE z.model_id = q.model_id) AS m, 0 AS k FROM q JOIN s0 USING (model_id)
 UNION ALL SELECT * FROM (SELECT ms.query_id, ms.model_id, go.dst, sum(ms.m * go.p), k + 1 FROM ms JOIN go ON go.query_id = ms.query_id AND go.sid = ms.sid WHERE k < 400 GROUP BY ms.query_id, ms.model_id, go.dst, k))"""


@query(f"{_PROB} SELECT q.query_id, round(coalesce((SELECT sum(m) FROM ms JOIN hits USING (query_id, sid) WHERE ms.query_id = q.query_id), 0), 6) AS prob, true AS prob_exact FROM q")
def quantitative(spark, sf_dir):
    """Exact probabilities; the network with an Erlang law is expanded first."""

    def answer(net, ctx, goal, i):
        found = kernels.quantitative(net, ctx, goal)
        return [(i, round(found["prob"], 6), found["prob_exact"])]

    return _ask(spark, sf_dir, "query_id string, prob double, prob_exact boolean", answer)


@query(f"""{_PROB} SELECT q.query_id, round(coalesce((SELECT sum(m / out) FROM ms JOIN ex USING (model_id, sid) WHERE ms.query_id = q.query_id AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = ms.query_id AND h.sid = ms.sid)), 0), 4) AS mean_time FROM q WHERE (SELECT sum(m) FROM ms JOIN hits USING (query_id, sid) WHERE ms.query_id = q.query_id) > 1 - 1e-9""")
def mean_hitting_time(spark, sf_dir):
    def answer(net, ctx, goal, i):
        time = kernels.quantitative(net, ctx, goal)["mean_time"]
        return [] if time is None else [(i, round(time, 4))]

    return _ask(spark, sf_dir, "query_id string, mean_time double", answer)


_LCG = """lp AS (SELECT model_id, automaton, f AS source, t AS target, [tid] AS path, [f, t] AS seen FROM m WHERE f <> t UNION ALL SELECT lp.model_id, lp.automaton, source, m.t, list_append(path, m.tid), list_append(seen, m.t) FROM lp JOIN m ON m.model_id = lp.model_id AND m.automaton = lp.automaton AND m.f = lp.target WHERE NOT list_contains(seen, m.t)),
first AS MATERIALIZED (SELECT model_id, automaton, unnest(range(levels)) AS level FROM a WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.model_id = a.model_id AND i.automaton = a.automaton) UNION SELECT model_id, automaton, level FROM i),
obj AS (SELECT query_id, model_id, automaton, level FROM q UNION SELECT obj.query_id, obj.model_id, c.automaton, c.level FROM obj JOIN first ON first.model_id = obj.model_id AND first.automaton = obj.automaton JOIN lp ON lp.model_id = obj.model_id AND lp.automaton = obj.automaton AND lp.source = first.level AND lp.target = obj.level JOIN c ON c.model_id = obj.model_id AND list_contains(lp.path, c.tid))"""


# A path takes its whole length, or from each condition's own delay the rest of the path from there on.
_DELAY = """sol AS MATERIALIZED (SELECT query_id, obj.model_id, obj.automaton, obj.level, row_number() OVER () AS sid, lp.path FROM obj JOIN first ON first.model_id = obj.model_id AND first.automaton = obj.automaton JOIN lp ON lp.model_id = obj.model_id AND lp.automaton = obj.automaton AND lp.source = first.level AND lp.target = obj.level),
stp AS (SELECT sid, query_id, model_id, unnest(path) AS tid, unnest(range(len(path))) AS pos FROM sol),
sfx AS MATERIALIZED (SELECT stp.*, sum(1 / rate) OVER (PARTITION BY sid ORDER BY pos DESC) AS rest FROM stp JOIN m USING (model_id, tid)),
tot AS MATERIALIZED (SELECT sid, max(rest) AS total FROM sfx GROUP BY sid),
atm AS MATERIALIZED (SELECT sid, query_id, c.automaton, c.level, rest FROM sfx JOIN c USING (model_id, tid)),
d0 AS MATERIALIZED (SELECT DISTINCT query_id, obj.automaton, obj.level, 0.0::DOUBLE AS v FROM obj JOIN first USING (model_id, automaton, level))"""
for _k in range(12):
    _DELAY += f""",
d{_k + 1} AS MATERIALIZED (SELECT * FROM d0 UNION ALL SELECT query_id, automaton, level, min(v) FROM (SELECT sol.query_id, sol.automaton, sol.level, sol.sid, greatest(any_value(total), coalesce(max(d.v + atm.rest), 0)) AS v FROM sol JOIN tot USING (sid) LEFT JOIN atm USING (sid) LEFT JOIN d{_k} d ON d.query_id = atm.query_id AND d.automaton = atm.automaton AND d.level = atm.level
  WHERE NOT EXISTS (SELECT 1 FROM d0 WHERE d0.query_id = sol.query_id AND d0.automaton = sol.automaton AND d0.level = sol.level) GROUP BY ALL HAVING count(atm.sid) = count(d.v)) GROUP BY ALL)"""


@query(f"{FX}, {_LCG}, {_DELAY} SELECT query_id, round(v, 6) AS delay FROM q JOIN d12 USING (query_id, automaton, level)")
def earliest_delay(spark, sf_dir):
    """The soonest that each goal may come about by mean delays, by rounds over all users' objectives."""
    models = networks(spark, sf_dir)
    return _rounded(causality.critical_delays(models, goals(models)).where("delay IS NOT NULL"), 6)


@query(f"{FX}, {_LCG}, {_DELAY} SELECT query_id, obj.automaton || '=' || obj.level AS objective FROM obj ANTI JOIN d12 USING (query_id, automaton, level)")
def dead_objectives(spark, sf_dir):
    """What each goal asks for and no derivation meets."""
    models = networks(spark, sf_dir)
    found = causality.dead_objectives(*causality.causality(models, goals(models)))
    return found.select("query_id", F.format_string("%s=%d", "automaton", "level").alias("objective"))


@query(f"""{FX}, {_LCG} SELECT query_id, obj.automaton || '=' || obj.level AS objective, CAST(coalesce(sum(CASE WHEN first.level = obj.level THEN 1 ELSE (SELECT count(*) FROM lp WHERE lp.model_id = obj.model_id AND lp.automaton = obj.automaton AND lp.source = first.level AND lp.target = obj.level) END), 0) AS INTEGER) AS solutions
FROM obj JOIN first ON first.model_id = obj.model_id AND first.automaton = obj.automaton GROUP BY query_id, obj.automaton, obj.level""")
def lcg_objectives(spark, sf_dir):
    """What each goal needs, and in how many ways, by rounds over all users' networks."""
    models = networks(spark, sf_dir)
    objectives, solutions, _ = causality.causality(models, goals(models))
    n = solutions.groupBy(*causality.OWN).agg(F.count(F.lit(1)).cast("int").alias("solutions"))
    return objectives.join(n, causality.OWN, "left").select("query_id", F.format_string("%s=%d", "automaton", "level").alias("objective"), F.coalesce("solutions", F.lit(0)).alias("solutions"))


# Runs up to 14 steps; the likeliest ones are shorter.
_RUNS = f"""{GRAPH}, {_HIT}, {_CONE}, mc AS (SELECT q.query_id, e.model_id, e.sid, e.dst, e.tid, e.rate FROM q JOIN e USING (model_id) JOIN m ON m.model_id = e.model_id AND m.tid = e.tid JOIN cone ON cone.query_id = q.query_id AND cone.node = m.automaton),
me AS MATERIALIZED (SELECT *, rate / sum(rate) OVER (PARTITION BY query_id, sid) AS p, 1 / sum(rate) OVER (PARTITION BY query_id, sid) AS tau FROM mc WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = mc.query_id AND h.sid = mc.sid)),
run AS (SELECT q.query_id, s0.sid, 1.0::DOUBLE AS p, 0.0::DOUBLE AS d, CAST([] AS VARCHAR[]) AS path FROM q JOIN s0 USING (model_id)
 UNION ALL SELECT run.query_id, me.dst, run.p * me.p, run.d + me.tau, list_append(path, txt.text) FROM run JOIN me ON me.query_id = run.query_id AND me.sid = run.sid JOIN txt ON txt.model_id = me.model_id AND txt.tid = me.tid WHERE len(path) < 14 AND run.p * me.p > 1e-3),
best AS (SELECT run.*, row_number() OVER (PARTITION BY query_id ORDER BY round(p, 12) DESC, len(path), path) AS rank FROM run JOIN hits USING (query_id, sid))"""


@query(f"{_RUNS} SELECT query_id, CAST(rank AS INTEGER) AS rank, round(p, 6) AS probability, round(d, 6) AS delay, coalesce(list_aggregate(path, 'string_agg', '; '), '') AS transitions FROM best WHERE rank <= 3")
def top_k_scenarios(spark, sf_dir):
    """The three likeliest runs to each goal. Phases are folded back into the moves they came from."""

    def answer(net, ctx, goal, i):
        for rank, (p, d, path) in enumerate(kernels.top_scenarios(net, ctx, goal, 3), 1):
            yield i, rank, round(p, 6), round(d, 6), "; ".join(path)

    return _ask(spark, sf_dir, "query_id string, rank int, probability double, delay double, transitions string", answer)


@query(f"{_RUNS} SELECT q.query_id, round(least(1.0, coalesce((SELECT sum(p) FROM best WHERE rank <= 4 AND best.query_id = q.query_id), 0.0)), 6) AS lower FROM q")
def anytime_bound(spark, sf_dir):
    return _ask(spark, sf_dir, "query_id string, lower double", lambda net, ctx, goal, i: [(i, round(kernels.anytime_bound(net, ctx, goal, 4), 6))])


# Runs end at the goal, or where an argument on local states excludes it. A node jumps while it holds LEAST mass.
_LEAST = 0.00137


@query(f"""{GRAPH}, {_HIT}, {_OA}, sm AS MATERIALIZED (SELECT r.model_id, r.sid, bit_or(bit.bit) AS mask FROM r JOIN a USING (model_id) JOIN bit ON bit.model_id = r.model_id AND bit.automaton = a.automaton AND bit.level = (r.sid // a.stride) % a.levels GROUP BY ALL),
sg AS (SELECT model_id, sid, mask, 0 AS k FROM sm UNION ALL SELECT sg.model_id, sg.sid, sg.mask | coalesce((SELECT bit_or(target) FROM rule WHERE rule.model_id = sg.model_id AND (sg.mask & need) = need), 0), k + 1 FROM sg WHERE k < 25),
stop AS MATERIALIZED (SELECT q.query_id, sg.sid, false AS hit FROM q JOIN bit USING (model_id, automaton, level) JOIN sg ON sg.model_id = q.model_id AND k = 25 WHERE (sg.mask & bit.bit) = 0 UNION ALL SELECT query_id, sid, true FROM hits),
jp AS MATERIALIZED (SELECT e.model_id, e.sid, e.dst, sum(e.rate) / any_value(x.out) AS p FROM e JOIN (SELECT model_id, sid, sum(rate) AS out FROM e GROUP BY ALL) x USING (model_id, sid) GROUP BY ALL),
go AS MATERIALIZED (SELECT q.query_id, jp.sid, jp.dst, jp.p FROM q JOIN jp USING (model_id) ANTI JOIN stop ON stop.query_id = q.query_id AND stop.sid = jp.sid),
fr AS (SELECT q.query_id, s0.sid, 1.0::DOUBLE / (SELECT count(*) FROM s0 z WHERE z.model_id = q.model_id) AS m, 0 AS k FROM q JOIN s0 USING (model_id)
 UNION ALL SELECT * FROM (SELECT fr.query_id, coalesce(go.dst, fr.sid) AS sid, sum(fr.m * coalesce(go.p, 1.0)), k + 1 FROM fr LEFT JOIN go ON go.query_id = fr.query_id AND go.sid = fr.sid AND fr.m >= {_LEAST} WHERE k < 16 GROUP BY fr.query_id, coalesce(go.dst, fr.sid), k))
SELECT query_id, k AS budget, round(coalesce(sum(m) FILTER (hit), 0), 6) AS lower, round(1 - coalesce(sum(m) FILTER (NOT hit), 0), 6) AS upper FROM fr LEFT JOIN stop USING (query_id, sid) WHERE k IN (1, 2, 4, 8, 16) GROUP BY query_id, k""")
def bracket(spark, sf_dir):
    """Bounds on every goal's probability by how many rounds of jumps were spent: what has got there, and what still may."""
    return _rounded(states.bracket(models := networks(spark, sf_dir), goals(models), (1, 2, 4, 8, 16), _LEAST), 6)


@query(f"""{FX}, {_LCG}, {_OA}, gb AS MATERIALIZED (SELECT query_id, q.model_id, bit AS goal FROM q JOIN bit USING (model_id, automaton, level)),
cand AS MATERIALIZED (SELECT o.query_id, o.model_id, o.automaton || '=' || o.level AS member, b.bit, goal FROM obj o JOIN bit b USING (model_id, automaton, level) JOIN gb USING (query_id) JOIN mask0 ON mask0.model_id = o.model_id WHERE b.bit <> goal AND (b.bit & seed) = 0),
combo AS (SELECT query_id, model_id, goal, [member] AS members, bit AS blk, member AS last FROM cand UNION ALL SELECT combo.query_id, combo.model_id, combo.goal, list_append(members, cand.member), blk | cand.bit, cand.member FROM combo JOIN cand ON cand.query_id = combo.query_id AND cand.member > combo.last WHERE len(members) < 3),
grow AS (SELECT query_id, combo.model_id, goal, members, blk, seed & ~blk AS mask, 0 AS k FROM combo JOIN mask0 USING (model_id) UNION ALL SELECT query_id, grow.model_id, goal, members, blk, grow.mask | (coalesce((SELECT bit_or(target) FROM rule WHERE rule.model_id = grow.model_id AND (grow.mask & need) = need), 0) & ~blk), k + 1 FROM grow WHERE k < 25),
cutting AS MATERIALIZED (SELECT * FROM grow WHERE k = 25 AND (mask & goal) = 0)
SELECT query_id, list_aggregate(members, 'string_agg', ',') AS members, CAST(len(members) AS INTEGER) AS size FROM cutting x WHERE NOT EXISTS (SELECT 1 FROM cutting y WHERE y.query_id = x.query_id AND y.blk <> x.blk AND (y.blk & x.blk) = y.blk)""")
def cutsets(spark, sf_dir):
    return _ask(spark, sf_dir, "query_id string, members string, size int", lambda net, ctx, goal, i: [(i, ",".join(c), len(c)) for c in kernels.cutsets(net, ctx, goal)])


@query(f"""{GRAPH}, ls AS MATERIALIZED (SELECT model_id, automaton, unnest(range(levels)) AS level, stride, levels FROM a),
can AS MATERIALIZED (SELECT DISTINCT ls.model_id, ls.automaton, ls.level FROM ls JOIN r ON r.model_id = ls.model_id AND (r.sid // stride) % levels = level),
rm AS (SELECT DISTINCT ls.model_id, ls.automaton AS frozen, ls.level AS lvl, s0.sid + (ls.level - (s0.sid // stride) % levels) * stride AS sid FROM ls JOIN s0 USING (model_id)
 UNION SELECT rm.model_id, frozen, lvl, e.dst FROM rm JOIN e ON e.model_id = rm.model_id AND e.sid = rm.sid JOIN m ON m.model_id = e.model_id AND m.tid = e.tid AND m.automaton <> rm.frozen)
SELECT DISTINCT ls.model_id, ls.automaton || '=' || ls.level AS goal, frozen || '=' || lvl AS target FROM ls ANTI JOIN can ON can.model_id = ls.model_id AND can.automaton = ls.automaton AND can.level = ls.level JOIN rm ON rm.model_id = ls.model_id AND (rm.sid // stride) % levels = ls.level""")
def mutations_enabling(spark, sf_dir):
    """For every local state that no run reaches, the frozen automata by which one does."""
    models = networks(spark, sf_dir)
    each = models.automata.select("model_id", "automaton", F.explode(F.sequence(F.lit(0), F.col("levels") - 1)).alias("level")).join(models.models.select("model_id", "text"), "model_id")

    def answer(net, q):
        goal = q["automaton"], int(q["level"])
        return [(q["model_id"], f"{goal[0]}={goal[1]}", t) for t in kernels.mutations(net, net.initial, goal, True)]

    return kernel(each.select(F.concat_ws("=", "automaton", "level").alias("key"), "model_id", "automaton", "level", "text"), "model_id string, goal string, target string", answer)


@query(f"{GRAPH}, {_HIT}, {_CONE} SELECT q.query_id, CASE WHEN EXISTS (SELECT 1 FROM hits JOIN r USING (model_id, sid) WHERE hits.query_id = q.query_id) THEN 'Reachable' ELSE 'Unreachable' END AS verdict, (SELECT CAST(count(*) AS INTEGER) FROM cone WHERE cone.query_id = q.query_id) AS cone_size FROM q")
def refinement(spark, sf_dir):
    def answer(net, ctx, goal, i):
        found = kernels.refine(net, ctx, goal)
        return [(i, found["verdict"], found["cone_size"])]

    return _ask(spark, sf_dir, "query_id string, verdict string, cone_size int", answer)


# Trajectories and reports.

_TRAJ = """w AS (SELECT epoch(date_trunc('day', ts))::BIGINT AS time, user_id, list_sort(list_distinct(list(event_type))) AS active FROM events GROUP BY ALL),
tr AS MATERIALIZED (SELECT time, active, count(*) / sum(count(*)) OVER (PARTITION BY time) AS p FROM w GROUP BY time, active)"""


def _trajectory(spark, sf_dir) -> DataFrame:
    """(time, active, p): by day, the shares of users by the set of event types they had."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    sets = e.groupBy(F.unix_seconds(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("time"), "user_id").agg(F.array_sort(F.collect_set("event_type")).alias("active"))
    n = sets.groupBy("time", "active").agg(F.count(F.lit(1)).alias("n"))
    return n.select("time", "active", (F.col("n") / F.sum("n").over(W.partitionBy("time"))).alias("p"))


@query(f"WITH {_TRAJ} SELECT time, round(coalesce(sum(p) FILTER (list_contains(active, 'purchase')), 0), 6) AS marginal FROM tr GROUP BY time")
def probtraj_marginal(spark, sf_dir):
    return api.marginals(_trajectory(spark, sf_dir), "purchase").withColumn("marginal", F.round("marginal", 6))


@query(f"WITH {_TRAJ}, mg AS (SELECT time, round(coalesce(sum(p) FILTER (list_contains(active, 'purchase')), 0), 9) AS marginal FROM tr GROUP BY time), lv(level) AS (VALUES (0.1), (0.15), (0.2), (0.25), (0.3)) SELECT CAST(level AS DOUBLE) AS level, (SELECT min(time) FROM mg WHERE marginal >= level) AS time FROM lv")
def first_passage(spark, sf_dir):
    return api.first_passages(api.marginals(_trajectory(spark, sf_dir), "purchase").withColumn("marginal", F.round("marginal", 9)), [0.1, 0.15, 0.2, 0.25, 0.3])


@query(f"WITH {_TRAJ}, nodes AS (SELECT DISTINCT unnest(active) AS node FROM tr), mg AS (SELECT node, time, round(sum(p) FILTER (list_contains(active, node)), 9) AS marginal FROM tr, nodes GROUP BY ALL) SELECT node, min(time) FILTER (marginal >= 0.3) AS time FROM mg GROUP BY node")
def activation_times(spark, sf_dir):
    return api.activation_times(_trajectory(spark, sf_dir), 0.3)


@query(f"""WITH RECURSIVE {EACH}, {MASS.format(ends="'purchase', 'error'")}, low AS (SELECT model_id, sum(m) AS binf FROM mass WHERE origin = 'view' AND node = 'purchase' AND k <= 3 GROUP BY ALL), ex AS (SELECT model_id, sum(m) AS exact FROM mass WHERE origin = 'view' AND node = 'purchase' GROUP BY ALL)
SELECT model_id, round(binf, 6) AS binf, round(exact, 6) AS exact, binf <= exact + 1e-9 AS sound, round(CASE WHEN exact <= 0 THEN 1 ELSE least(1, greatest(0, binf / exact)) END, 6) AS tightness, round(CASE WHEN exact <= 0 THEN 0 ELSE greatest(0, (exact - binf) / exact) END, 6) AS rel_gap FROM ex JOIN low USING (model_id)""")
def validation_metrics(spark, sf_dir):
    """How good three jumps are as a lower bound, by user."""
    edges = _chain(spark, sf_dir, True)
    exact = _purchase(edges).where("node = 'view'").select("model_id", F.col("prob").alias("exact"))
    jumps = chains.jump_chain(edges.where("src not in ('purchase', 'error')"))
    start = edges.where("src = 'view'").select("model_id", F.lit("view").alias("origin"), F.lit("view").alias("node")).distinct()
    low = chains.transient_mass(jumps, start, 3).where("node = 'purchase'").select("model_id", F.col("mass").alias("binf"))
    found = api.bound_metrics(exact.join(low, "model_id"), "binf", "exact")
    return found.select("model_id", *(F.round(c, 6).alias(c) for c in ("binf", "exact")), "sound", *(F.round(c, 6).alias(c) for c in ("tightness", "rel_gap")))


@query("""WITH s AS (SELECT user_id, list_distinct(list(event_type) FILTER (hour(ts) < 12)) AS v, list_distinct(list(event_type) FILTER (hour(ts) >= 12)) AS u FROM events GROUP BY ALL)
SELECT user_id, round(CASE WHEN len(list_distinct(list_concat(v, u))) = 0 THEN 1.0 ELSE len(list_intersect(coalesce(v, []), coalesce(u, []))) / len(list_distinct(list_concat(v, u))) END, 6) AS jaccard FROM s""")
def jaccard(spark, sf_dir):
    """Likeness of a user's event types before and after noon."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("early", F.hour(F.col("ts").cast("timestamp")) < 12)
    sets = e.groupBy("user_id").agg(*(F.collect_set(F.when(F.col("early") == x, F.col("event_type"))).alias(n) for n, x in (("a", True), ("b", False))))
    return sets.select("user_id", F.round(api.jaccard("a", "b"), 6).alias("jaccard"))


@query(f"{GRAPH} SELECT model_id AS model, n AS states, (SELECT count(*) FROM r WHERE r.model_id = size.model_id) AS value FROM size")
def sweep_reachability(spark, sf_dir):
    """Sizes and numbers of reachable states of all models, in one job."""
    return api.sweep(networks(spark, sf_dir)).select("model", F.col("states").cast("long").alias("states"), F.col("value").cast("long").alias("value"))


@query(ORACLES["symbolic_reachability"])
def symbolic_reachability_by_rounds(spark, sf_dir):
    """The same by rounds of joins, as for a space beyond one task."""
    return states.symbolic_reachability(models := networks(spark, sf_dir), goals(models), rounds=True).withColumn("reachable_states", F.col("reachable_states").cast("long"))


@query(f"{GRAPH} SELECT model_id, (SELECT count(*) FROM r WHERE r.model_id = size.model_id) AS reachable_states FROM size")
def decision_diagrams(spark, sf_dir):
    return kernel(networks(spark, sf_dir).models, "model_id string, reachable_states long", lambda net, q: [(q["model_id"], diagrams.reachability(net, net.initial, None)[1])])


@query(f"{_PHASED} SELECT model_id, tid::INTEGER AS tid, round(sum(1 / r), 6) AS mean, round(1 / sum(1 / r), 6) AS rate, CAST(count(*) AS INTEGER) AS phases, any_value(kind) = 'exp' AS exponential, '__' || model_id || '_' || tid AS ident FROM ph JOIN m USING (model_id, tid) GROUP BY ALL")
def scalar_functions(spark, sf_dir):
    t = _phased(networks(spark, sf_dir)).transitions.withColumn("label", F.concat_ws("-", F.lit(""), "model_id", "tid"))
    return t.select("model_id", "tid", F.round(scalars.law_mean("dist.rates"), 6).alias("mean"), F.round(scalars.law_rate("dist.rates"), 6).alias("rate"), scalars.phase_count("dist.rates").alias("phases"), scalars.is_exponential("dist.kind").alias("exponential"), scalars.identifier("label").alias("ident"))


def _texts(writer: str, sql: str):
    def run(spark, sf_dir):
        return kernel(networks(spark, sf_dir).models, "model_id string, text string", lambda net, q: [(q["model_id"], WRITERS[writer](net))])

    run.__name__ = f"write_{writer}"
    query(sql)(run)


# The networks' names need no escaping in the languages of the tools.
_IDS = "SELECT DISTINCT model_id FROM a"
_LOW = "coalesce((SELECT min(level) FROM i WHERE i.model_id = a.model_id AND i.automaton = a.automaton), 0)"
_GUARD = "coalesce((SELECT string_agg('{sep}' || c.automaton || '{eq}' || c.level, '' ORDER BY c.k) FROM c WHERE c.model_id = m.model_id AND c.tid = m.tid), '')"
_texts("an", f"""{FX} SELECT model_id, (SELECT string_agg('"' || automaton || '" [' || list_aggregate(range(levels), 'string_agg', ', ') || ']', chr(10) ORDER BY automaton) FROM a WHERE a.model_id = x.model_id) || chr(10) || chr(10) ||
(SELECT string_agg('"' || automaton || '" ' || f || ' -> ' || t || coalesce((SELECT ' when ' || string_agg('"' || c.automaton || '"=' || c.level, ' and ' ORDER BY c.k) FROM c WHERE c.model_id = m.model_id AND c.tid = m.tid), '') || ' @ ' || CAST(CAST(rate AS DOUBLE) AS VARCHAR), chr(10) ORDER BY tid) FROM m WHERE m.model_id = x.model_id) || chr(10) || chr(10) ||
(SELECT 'initial_state ' || string_agg('"' || automaton || '"=' || level, ', ' ORDER BY automaton, level) FROM i WHERE i.model_id = x.model_id) || chr(10) AS text FROM ({_IDS}) x""")
_texts("dot", f"""{FX} SELECT model_id, 'digraph "model" {{' || chr(10) || '  rankdir=LR;' || chr(10) || '  node [shape=ellipse];' || chr(10) ||
(SELECT string_agg('  "' || automaton || '" [label="' || automaton || chr(92) || 'n|S|=' || levels || '"];' || chr(10), '' ORDER BY automaton) FROM a WHERE a.model_id = x.model_id) ||
coalesce((SELECT string_agg('  "' || regulator || '" -> "' || automaton || '";' || chr(10), '' ORDER BY automaton, regulator) FROM reg WHERE reg.model_id = x.model_id), '') || '}}' || chr(10) AS text FROM ({_IDS}) x""")
_texts("prism", f"""{FX} SELECT model_id, 'ctmc' || chr(10) || chr(10) || 'module network' || chr(10) || (SELECT string_agg('  ' || automaton || ' : [0..' || (levels - 1) || '] init ' || {_LOW} || ';' || chr(10), '' ORDER BY automaton) FROM a WHERE a.model_id = x.model_id) || chr(10) ||
(SELECT string_agg('  [] ' || automaton || '=' || f || {_GUARD.format(sep=' & ', eq='=')} || ' -> ' || CAST(CAST(rate AS DOUBLE) AS VARCHAR) || ' : (' || automaton || chr(39) || '=' || t || ');' || chr(10), '' ORDER BY tid) FROM m WHERE m.model_id = x.model_id) ||
'endmodule' || chr(10) || chr(10) || 'rewards "time"' || chr(10) || '  true : 1;' || chr(10) || 'endrewards' || chr(10) AS text FROM ({_IDS}) x""")
_texts("nusmv", f"""{FX} SELECT model_id, 'MODULE main' || chr(10) || 'VAR' || chr(10) || (SELECT string_agg('  ' || automaton || ' : 0..' || (levels - 1) || ';' || chr(10), '' ORDER BY automaton) FROM a WHERE a.model_id = x.model_id) ||
'IVAR' || chr(10) || '  sel : {{' || (SELECT string_agg(automaton, ', ' ORDER BY automaton) FROM a WHERE a.model_id = x.model_id) || '}};' || chr(10) || 'ASSIGN' || chr(10) ||
(SELECT string_agg('  init(' || automaton || ') := ' || {_LOW} || ';' || chr(10), '' ORDER BY automaton) FROM a WHERE a.model_id = x.model_id) ||
(SELECT string_agg('  next(' || automaton || ') :=' || chr(10) || '    case' || chr(10) || coalesce((SELECT string_agg('      sel = ' || m.automaton || ' & ' || m.automaton || ' = ' || f || {_GUARD.format(sep=' & ', eq=' = ')} || ' : ' || t || ';' || chr(10), '' ORDER BY tid) FROM m WHERE m.model_id = a.model_id AND m.automaton = a.automaton), '') || '      TRUE : ' || automaton || ';' || chr(10) || '    esac;' || chr(10), '' ORDER BY automaton) FROM a WHERE a.model_id = x.model_id) AS text FROM ({_IDS}) x""")


# Logical texts made from tables: each nation of the trade graph rises where all its sources are as their signs say. Of
# such a conjunction the falling clauses are disjoint in one format, prefixes of the sorted sources, and single in the
# other.
_LOGIC = f"""WITH {_TRADE.format(top=3)}, lg AS MATERIALIZED (SELECT replace(dst, ' ', '_') AS node, replace(src, ' ', '_') AS reg, CASE WHEN sign = 1 THEN 1 ELSE 0 END AS v, row_number() OVER (PARTITION BY dst ORDER BY replace(src, ' ', '_')) AS k FROM tr),
up AS (SELECT node, node || ': 0 -> 1 when ' || string_agg(reg || '=' || v, ' and ' ORDER BY k) AS text FROM lg GROUP BY node)"""


def _logic(spark, sf_dir) -> DataFrame:
    """(node, regs): each nation with sources, and their names and signs in order."""
    safe = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("_"))
    tr = _trade(spark, sf_dir, 3).select(safe("dst").alias("node"), F.struct(safe("src").alias("reg"), (F.col("sign") == 1).alias("up")).alias("x"))
    return tr.groupBy("node").agg(F.array_sort(F.collect_list("x")).alias("regs"))


def _rule() -> Column:
    return F.array_join(F.transform("regs", lambda x: F.concat(F.when(x["up"], "").otherwise("!"), x["reg"])), " & ")


def _read_back(texts: DataFrame) -> DataFrame:
    return structure.transition_texts(m := Models.from_texts(texts)).join(m.transitions.select("model_id", "tid", "rate"), ["model_id", "tid"]).select("automaton", "text", F.round("rate", 6).alias("rate"))


@query(f"""{_LOGIC} SELECT node AS automaton, text, 1.0::DOUBLE AS rate FROM up
UNION ALL SELECT x.node, x.node || ': 1 -> 0 when ' || string_agg(y.reg || '=' || CASE WHEN y.k = x.k THEN 1 - y.v ELSE y.v END, ' and ' ORDER BY y.k), 1.0::DOUBLE FROM lg x JOIN lg y ON y.node = x.node AND y.k <= x.k GROUP BY x.node, x.k""")
def read_bnet_texts(spark, sf_dir):
    """Each nation a BoolNet text of its own; names that only stand in functions are no targets."""
    text = F.concat(F.lit("targets, factors\n"), F.col("node"), F.lit(", "), _rule(), F.lit("\n"))
    return _read_back(_logic(spark, sf_dir).select(F.col("node").alias("model_id"), F.lit("bnet").alias("format"), text.alias("text")))


@query(f"""{_LOGIC}, n AS (SELECT node, count(*) AS n FROM lg GROUP BY node) SELECT node AS automaton, text, (n + 0.5)::DOUBLE AS rate FROM up JOIN n USING (node)
UNION ALL SELECT node, node || ': 1 -> 0 when ' || reg || '=' || (1 - v), 0.25::DOUBLE FROM lg""")
def read_maboss_texts(spark, sf_dir):
    """Each nation a MaBoSS model of one node, whose parameters are in a second text."""
    node = F.concat(F.lit("node "), F.col("node"), F.lit(" {\n  logic = "), _rule(), F.lit(";\n  rate_up = @logic ? $up : 0; // rises\n  rate_down = @logic ? 0 : $down;\n}\n"))
    extra = F.concat(F.lit("$up = "), F.size("regs").cast("string"), F.lit(".5;\n$down = 0.25;\n"), F.col("node"), F.lit(".istate = 0;\n"))
    return _read_back(_logic(spark, sf_dir).select(F.col("node").alias("model_id"), F.lit("maboss").alias("format"), node.alias("text"), extra.alias("extra")))


@query(f"""{_LOGIC} SELECT node, true AS rises, 0 AS clause, reg AS variable, v AS value FROM lg
UNION ALL SELECT node, false, CAST(k - 1 AS INTEGER), reg, 1 - v FROM lg""")
def logic_clauses(spark, sf_dir):
    """The clauses under which each nation rises or falls, by a table function in SQL."""
    spark_sources.register(spark)
    rules = _logic(spark, sf_dir).select("node", _rule().alias("logic"))
    both = "SELECT node, true AS rises, logic FROM {rules} UNION ALL SELECT node, false, concat('!(', logic, ')') FROM {rules}"
    return spark.sql(f"SELECT node, rises, d.clause, d.variable, d.value FROM ({both}), LATERAL dnf(logic) d", rules=rules)


@query(ORACLES["local_paths"])
def local_paths_in_sql(spark, sf_dir):
    """Paths inside the automata of all users' networks, by a table function in SQL over their texts."""
    spark_sources.register(spark)
    models = networks(spark, sf_dir)
    asked = models.automata.select("model_id", "automaton").join(models.models.select("model_id", "text"), "model_id")
    found = spark.sql("SELECT model_id, automaton, p.source, p.target, p.path FROM {asked}, LATERAL local_paths(text, automaton) p", asked=asked)
    return found.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ","))


@query(f"{FX} SELECT model_id, count(*) AS transitions, round(sum(rate), 6) AS rates FROM m GROUP BY model_id")
def read_anx_texts(spark, sf_dir):
    """Models parsed from their texts on the executors."""
    texts = networks(spark, sf_dir).models.select("model_id", F.lit("anx").alias("format"), "text")
    return Models.from_texts(texts).transitions.groupBy("model_id").agg(F.count(F.lit(1)).alias("transitions"), F.round(F.sum("rate"), 6).alias("rates"))


# A network for each user, from the events.



@query(f"{FX} SELECT model_id, tid::INTEGER AS tid, text FROM txt")
def user_networks(spark, sf_dir):
    """A Boolean network of event types for each user."""
    return structure.transition_texts(networks(spark, sf_dir)).select("model_id", "tid", "text")


@query(f"{GRAPH}, {_FIX} SELECT model_id, state, false AS truncated FROM fx JOIN name USING (model_id, sid)")
def user_fixpoints(spark, sf_dir):
    return states.fixpoints(networks(spark, sf_dir))


@query(f"{GRAPH} SELECT model_id AS model, n AS states, (SELECT count(*) FROM r WHERE r.model_id = size.model_id) AS value FROM size")
def user_sweep(spark, sf_dir):
    """States, and states reachable from the user's first event, of every user's network."""
    return api.sweep(networks(spark, sf_dir)).select("model", F.col("states").cast("long").alias("states"), F.col("value").cast("long").alias("value"))


@query(f"{FX}, {_OA}, {_GROW.format(key='model_id AS mid', seed='seed', base='mask0', gk='mid', but='', free='', join='')} SELECT grow.model_id, automaton, level::INTEGER AS level FROM grow JOIN bit ON bit.model_id = grow.model_id AND (bit.bit & mask) <> 0 WHERE k = 25")
def user_may_reach(spark, sf_dir):
    """Event types that can't be excluded after the user's first event, and those that can stop."""
    return local.may_reach(networks(spark, sf_dir)).drop("variant")


@query(f"{FX}, {_CIRCUITS.format(g='inf')} SELECT model_id, count(*) AS total, count(*) FILTER (sign = 1) AS positive, count(*) FILTER (sign = -1) AS negative, false AS truncated FROM cyc GROUP BY model_id")
def user_feedback(spark, sf_dir):
    return structure.feedback(structure.circuits(structure.influences(networks(spark, sf_dir))))


@query(f"""{GRAPH}, hits AS MATERIALIZED (SELECT a.model_id, st.sid FROM a JOIN st ON st.model_id = a.model_id AND (st.sid // a.stride) % a.levels = 1 WHERE a.automaton = 'purchase'),
ex AS MATERIALIZED (SELECT model_id, sid, sum(rate) AS out FROM e GROUP BY ALL),
jp AS MATERIALIZED (SELECT e.model_id, e.sid, e.dst, sum(e.rate / ex.out) AS p FROM e JOIN ex USING (model_id, sid) ANTI JOIN hits USING (model_id, sid) GROUP BY ALL),
ms AS (SELECT model_id, sid, 1.0::DOUBLE AS m, 0 AS k FROM s0 UNION ALL SELECT * FROM (SELECT ms.model_id, jp.dst, sum(ms.m * jp.p), k + 1 FROM ms JOIN jp ON jp.model_id = ms.model_id AND jp.sid = ms.sid WHERE k < 400 GROUP BY ms.model_id, jp.dst, k))
SELECT model_id, round(coalesce((SELECT sum(m) FROM ms JOIN hits USING (model_id, sid) WHERE ms.model_id = x.model_id), 0), 5) AS prob, true AS prob_exact FROM a x WHERE automaton = 'purchase'""")
def user_purchase_probability(spark, sf_dir):
    """The chance that purchase gets active, in each user's network that has it."""
    found = api.quantitative(networks(spark, sf_dir), ["purchase=1"])
    return found.select("model_id", F.round("prob", 5).alias("prob"), "prob_exact")


# Rounds over the cluster, without a task a model.

_BUYS = """buy AS (SELECT l_partkey AS part, o_custkey AS cust, o_orderdate AS day, o_orderkey AS ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IS NOT NULL AND l_partkey IS NOT NULL),
link AS MATERIALIZED (SELECT DISTINCT arg_min(cust, (day, ord, cust)) AS src, arg_max(cust, (day, ord, cust)) AS dst FROM buy GROUP BY part)"""


@query(f"""WITH RECURSIVE {_BUYS}, cl AS (SELECT src, dst FROM link UNION SELECT cl.src, link.dst FROM cl JOIN link ON link.src = cl.dst),
mate AS (SELECT x.src AS node, x.dst AS other FROM cl x JOIN cl y ON y.src = x.dst AND y.dst = x.src)
SELECT n.node, least(n.node, coalesce(min(other), n.node)) AS comp FROM (SELECT src AS node FROM link UNION SELECT dst FROM link) n LEFT JOIN mate USING (node) GROUP BY n.node""")
def customer_components(spark, sf_dir):
    """Strong components of customers, each part leading from the customer who first bought it to the one who last did."""
    li, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    buys = li.select("l_partkey", F.col("l_orderkey").alias("o_orderkey")).join(o.select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey").where("o_custkey IS NOT NULL AND l_partkey IS NOT NULL")
    at = F.struct("o_orderdate", "o_orderkey", "o_custkey")
    links = buys.groupBy("l_partkey").agg(F.min(at)["o_custkey"].alias("src"), F.max(at)["o_custkey"].alias("dst")).select(F.lit("parts").alias("model_id"), "src", "dst").distinct()
    return graphs.strong_components(links).select("node", "comp")


@query(ORACLES["attractors"])
def user_attractors(spark, sf_dir):
    """Terminal components of every user's whole state space, by rounds."""
    models = networks(spark, sf_dir)
    found = states.attractors_by_rounds(models).groupBy("model_id", "attractor").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.array_sort(F.collect_list("state")), " | ").alias("states"))
    return found.select("model_id", "size", "states", F.lit(False).alias("truncated"))


@query(f"""{GRAPH}, {_HIT}, lay AS (SELECT model_id, sid, 0 AS d FROM s0 UNION SELECT e.model_id, e.dst, d + 1 FROM lay JOIN e ON e.model_id = lay.model_id AND e.sid = lay.sid WHERE d < 40),
dep AS MATERIALIZED (SELECT model_id, sid, min(d) AS d FROM lay GROUP BY ALL),
par AS MATERIALIZED (SELECT t.model_id, t.sid, min({{'tid': e.tid, 'sid': e.sid}}) AS way FROM dep t JOIN e ON e.model_id = t.model_id AND e.dst = t.sid JOIN dep f ON f.model_id = e.model_id AND f.sid = e.sid AND f.d = t.d - 1 GROUP BY ALL),
fin AS (SELECT query_id, hits.model_id, min({{'d': d, 'sid': hits.sid}}) AS fin FROM hits JOIN dep ON dep.model_id = hits.model_id AND dep.sid = hits.sid GROUP BY ALL),
walk AS (SELECT query_id, model_id, fin.d AS steps, fin.sid AS sid, CAST([] AS VARCHAR[]) AS run, fin.d AS d FROM fin
 UNION ALL SELECT query_id, walk.model_id, steps, way.sid, list_prepend(txt.text, run), d - 1 FROM walk JOIN par ON par.model_id = walk.model_id AND par.sid = walk.sid JOIN txt ON txt.model_id = walk.model_id AND txt.tid = way.tid WHERE d > 0)
SELECT query_id, CAST(steps AS INTEGER) AS steps, coalesce(list_aggregate(run, 'string_agg', '; '), '') AS run FROM walk WHERE d = 0""")
def user_witnesses(spark, sf_dir):
    """A shortest run to each goal that a user's network reaches."""
    models = networks(spark, sf_dir)
    found = runs.shortest_runs(models, goals(models))
    each = found.select("query_id", "model_id", "steps", F.posexplode_outer("run").alias("at", "tid")).join(structure.transition_texts(models).select("model_id", "tid", "text"), ["model_id", "tid"], "left")
    lines = each.groupBy("query_id", "steps").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("at", "text")))).alias("lines"))
    return lines.select("query_id", "steps", F.array_join(F.transform("lines", lambda x: x["text"]), "; ").alias("run"))


@query(f"""WITH RECURSIVE {EACH}, st AS (SELECT 'u' || user_id AS model_id, arg_min(event_type, (ts, event_id)) AS node FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL),
c AS MATERIALIZED (SELECT model_id, src, dst, CAST(round(-ln(p) * 1e9) AS BIGINT) AS c FROM p WHERE src <> 'purchase'),
run AS (SELECT model_id, node, 0::BIGINT AS cost, [node] AS run, 0 AS k FROM st
 UNION ALL SELECT run.model_id, c.dst, run.cost + c.c, list_append(run, c.dst), k + 1 FROM run JOIN c ON c.model_id = run.model_id AND c.src = run.node WHERE k < 30 QUALIFY row_number() OVER (PARTITION BY run.model_id, c.dst ORDER BY run.cost + c.c, list_append(run, c.dst)) <= 5),
best AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY cost, run) AS rank FROM run WHERE node = 'purchase')
SELECT model_id, CAST(rank AS INTEGER) AS rank, round(exp(-cost / 1e9), 6) AS prob, list_aggregate(run, 'string_agg', ' > ') AS run FROM best WHERE rank <= 5""")
def user_likeliest_runs(spark, sf_dir):
    """The five likeliest ways from each user's first event to a purchase."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    jumps = chains.jump_chain(derive.event_chain(events, True))
    begun = events.where("ts IS NOT NULL AND event_type IS NOT NULL").groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("model_id")).agg(F.min(F.struct(derive.micros("ts"), "event_id", "event_type"))["event_type"].alias("node"))
    goal = jumps.select("model_id", F.lit("purchase").alias("node")).distinct()
    found = runs.likeliest_runs(jumps, begun, goal)
    return found.select("model_id", "rank", F.round("prob", 6).alias("prob"), F.array_join("run", " > ").alias("run"))


@query(ORACLES["cutsets"].replace("(SELECT query_id, q.model_id, bit AS goal FROM q JOIN bit USING (model_id, automaton, level)),\ncand", f"(SELECT query_id, q.model_id, bit AS goal FROM q JOIN bit USING (model_id, automaton, level)){_CAN},\ncand").replace("FROM cutting x WHERE", "FROM cutting x SEMI JOIN can USING (query_id) WHERE"))
def user_cutsets(spark, sf_dir):
    """Smallest sets of up to three local states that exclude a goal which is possible, for every user's network."""
    return local.cutsets_by_levels(models := networks(spark, sf_dir), goals(models))


# Networks beyond enumeration, of any number of automata, and what is known of them in closed form.


def ring(n: int) -> Network:
    """n Boolean automata, each of which copies the one before it; the first one may start anywhere, the others at 0."""
    names = [f"x{k:03d}" for k in range(n)]
    moves = {a: [Move(a, 0, 1, ((names[k - 1], 1),)), Move(a, 1, 0, ((names[k - 1], 0),))] for k, a in enumerate(names)}
    return Network(f"ring{n}", dict.fromkeys(names, 2), moves, {a: frozenset((0,)) for a in names[1:]})


def _sizes(spark, sf_dir) -> list[int]:
    """The lengths of rings; as many as a user can have days, a few dozen here."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("ts IS NOT NULL")
    return [r.n for r in e.groupBy("user_id").agg((20 + F.countDistinct(F.to_date(F.col("ts").cast("timestamp")))).alias("n")).select("n").distinct().collect()]


def _rings(spark, sf_dir) -> Models:
    return Models.of(spark, {f"ring{n}": ring(n) for n in _sizes(spark, sf_dir)})


#: Rings as long as users have days with events, and 20 more.
_SIZES = "n(n) AS (SELECT DISTINCT 20 + count(DISTINCT CAST(ts AS DATE)) FROM events WHERE ts IS NOT NULL GROUP BY user_id)"
_ALL = f"{_SIZES}, al AS (SELECT n, string_agg('x' || lpad(k::VARCHAR, 3, '0') || '=0', ', ' ORDER BY k) AS low, string_agg('x' || lpad(k::VARCHAR, 3, '0') || '=1', ', ' ORDER BY k) AS high FROM n, LATERAL (SELECT unnest(range(n)) AS k) GROUP BY n)"


@query(f"WITH {_ALL} SELECT 'ring' || n AS model_id, unnest([low, high]) AS state, false AS truncated FROM al")
def ring_fixpoints(spark, sf_dir):
    """Rings rest where all are alike."""
    return states.fixpoints(_rings(spark, sf_dir))


@query(f"WITH {_ALL} SELECT 'ring' || n AS model_id, unnest(['', low, high]) AS space, false AS minimal FROM al UNION ALL SELECT 'ring' || n, unnest([low, high]), true FROM al")
def ring_trap_spaces(spark, sf_dir):
    models = _rings(spark, sf_dir)
    return states.trap_spaces(models).select("model_id", "space", F.lit(False).alias("minimal")).union(states.trap_spaces(models, minimal=True).select("model_id", "space", F.lit(True)))


@query(f"WITH {_SIZES} SELECT 'ring' || n AS model_id, 'x' || lpad(k::VARCHAR, 3, '0') AS automaton, v::INTEGER AS level FROM n, LATERAL (SELECT unnest(range(n)) AS k), (SELECT unnest([0, 1]) AS v)")
def ring_may_reach(spark, sf_dir):
    return local.may_reach(_rings(spark, sf_dir)).drop("variant")


@query(f"WITH {_SIZES} SELECT 'ring' || n AS query_id, 'x' || lpad(k::VARCHAR, 3, '0') || '=1' AS member FROM n, LATERAL (SELECT unnest(range(1, n)) AS k) WHERE k <> n - 1")
def ring_cutsets(spark, sf_dir):
    """Each automaton between the first and the last is one without which the last never rises."""
    asked = [(f"ring{n}", f"ring{n}", f"x{n - 1:03d}", 1) for n in _sizes(spark, sf_dir)]
    return local.single_cutsets(_rings(spark, sf_dir), spark.createDataFrame(asked, "query_id string, model_id string, automaton string, level int"))


# Of a state with d changes around the ring, each move keeps or lowers d: states with at most two changes are reached.
@query(f"WITH {_SIZES} SELECT 'ring' || n AS model, CAST(n AS INTEGER) AS automata, CAST(2 + n * (n - 1) AS DOUBLE) AS value FROM n")
def ring_sweep(spark, sf_dir):
    return api.sweep(_rings(spark, sf_dir)).select("model", "automata", F.col("value").cast("double").alias("value"))


# The first one starts at 0, or at 1 with 0 elsewhere, a stretch of ones whose ends move alike until it or the gap is gone.
@query(f"WITH {_SIZES} SELECT 'ring' || n AS model_id, round(0.5 / n, 6) AS prob, true AS prob_exact FROM (SELECT DISTINCT 8 + n % 5 AS n FROM n)")
def ring_probability(spark, sf_dir):
    """The chance that all of a small ring get to 1: a watcher rises where they are."""
    nets = {}
    for n in {8 + n % 5 for n in _sizes(spark, sf_dir)}:
        net = ring(n)
        net.levels["watch"] = 2
        net.moves["watch"] = [Move("watch", 0, 1, tuple((f"x{k:03d}", 1) for k in range(n)))]
        net.initial["watch"] = frozenset((0,))
        nets[f"ring{n}"] = net
    found = api.quantitative(Models.of(spark, nets), ["watch=1"])
    return found.select("model_id", F.round("prob", 6).alias("prob"), "prob_exact")

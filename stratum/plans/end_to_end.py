"""Registered queries of a whole search over the documents, with DuckDB SQL.

Questions are the benchmark's texts and each document's first line that holds an identifier; a line longer than a request may be
is refused, as any request is. A passage's version is the first in its text, its class goes by its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions import identifiers as I
from stratum.functions import text as T
from stratum.operators import assembly, retrieval, search
from stratum.plans import catalog
from stratum.plans.registry import query
from stratum.runtime import spread
from stratum.sources.tables import table

D = T.DUCK
COMMON, WINDOW, BYTES = 50, 200, 20_000
SETTINGS = search.Settings(common=COMMON, window_words=WINDOW, blend=0.3, source_weight=0.6, cap=3, most_bytes=BYTES)


def _words(x: str) -> str:
    return f"list_distinct(list_filter(string_split({T.prompt_form(x, D)}, ' '), lambda w: w <> ''))"


def _literal(text: str) -> str:
    """``inventory.has_literal`` in patterns without look-around."""
    edge, other = r"[^\p{L}\p{N}_\-/\\:.]", r"[^\p{L}\p{N}]"
    return f"regexp_matches({text}, '(^|{edge}|(^|{other})\\.)' || regexp_escape(identifier) || '($|{edge}|\\.($|{other}))')"


_SEARCH = f"""qs AS (SELECT 'b' || item_id AS query_id, coalesce(text, '') AS text FROM benchmark UNION ALL
  SELECT 'd' || doc_id, l FROM (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
  WHERE len({I.index_identifiers('l', D)}) > 0) WHERE r = 1 AND strlen(l) <= {retrieval.MOST_QUERY_BYTES}),
dd AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, coalesce(text, '') AS text, CASE WHEN lower(source) = 'src1' THEN 'official_docs' WHEN starts_with(source, 'src1') THEN 'community' END AS source_class, {I.found("coalesce(text, '')", 'version', D)}[1] AS version FROM documents),
{catalog._terms('d', 'dd', 'chunk_id')}, {catalog._terms('q', 'qs', 'query_id')}, {catalog._AVG},
st AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM d_tf, av GROUP BY term),
rs AS (SELECT query_id, d_tf.id AS id, round(sum(idf * {catalog._WEIGHT}), 6) AS score FROM d_tf JOIN (SELECT id AS query_id, term AS q_term FROM q_tf) ON d_tf.term = q_term JOIN st ON d_tf.term = st.term, av GROUP BY query_id, d_tf.id),
lx AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM rs) WHERE n <= 200),
tg AS (SELECT query_id, n, id, score AS leader, 0 AS grp FROM lx WHERE n = 1
  UNION ALL SELECT lx.query_id, lx.n, lx.id, CASE WHEN tg.leader - lx.score <= 1e-5 * greatest(1, abs(tg.leader)) THEN tg.leader ELSE lx.score END, CASE WHEN tg.leader - lx.score <= 1e-5 * greatest(1, abs(tg.leader)) THEN tg.grp ELSE tg.grp + 1 END
  FROM tg JOIN lx ON lx.query_id = tg.query_id AND lx.n = tg.n + 1),
po AS (SELECT DISTINCT chunk_id, unnest({I.index_identifiers('text', D)}) AS identifier FROM dd),
wa AS (SELECT DISTINCT query_id, unnest({I.index_identifiers('text', D)}) AS identifier FROM qs),
cm AS (SELECT identifier FROM po GROUP BY identifier HAVING count(*) <= {COMMON}),
hits AS (SELECT * FROM (SELECT query_id, 'lexical' AS route, id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY grp, id) AS rank FROM tg) WHERE rank <= 100
  UNION ALL SELECT * FROM (SELECT query_id, 'identifier' AS route, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank FROM (SELECT DISTINCT query_id, chunk_id FROM wa JOIN cm USING (identifier) JOIN po USING (identifier))) WHERE rank <= 20),
fs AS (SELECT query_id, chunk_id, coalesce(max(CASE WHEN route = 'lexical' THEN 1.0 / CAST(60 + rank AS DOUBLE) END), 0) + coalesce(max(CASE WHEN route = 'identifier' THEN 1.0 / CAST(60 + rank AS DOUBLE) END), 0) AS score FROM hits GROUP BY 1, 2),
fused AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS position FROM fs) WHERE position < 120),
wp AS (SELECT chunk_id, regexp_extract_all(text, '^\\s+|\\S+\\s*') AS p FROM dd WHERE chunk_id IN (SELECT chunk_id FROM fused WHERE position < 30)),
wn AS (SELECT chunk_id, {_words('w')} AS w FROM (SELECT chunk_id, array_to_string(list_slice(p, n * {WINDOW} + 1, n * {WINDOW} + {WINDOW}), '') AS w FROM (SELECT chunk_id, p, unnest(range(0, CAST(ceil(len(p) / {WINDOW}) AS BIGINT))) AS n FROM wp WHERE len(p) > 0))),
qw AS (SELECT query_id, {_words('text')} AS q FROM qs),
sc AS (SELECT query_id, chunk_id, max(len(list_intersect(q, w))) AS s FROM fused JOIN qw USING (query_id) JOIN wn USING (chunk_id) WHERE position < 30 GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, position) - 1 AS reranked FROM fused LEFT JOIN sc USING (query_id, chunk_id)),
m AS (SELECT o.*, CASE WHEN source_class = 'community' THEN 1 - 0.6 ELSE 1.0 END AS m FROM o JOIN dd USING (chunk_id)),
bl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY 0.7 / CAST(61 + reranked AS DOUBLE) + 0.3 / CAST(61 + position AS DOUBLE) DESC, position) - 1 AS blended FROM m),
dm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CAST(m AS DOUBLE) / CAST(blended + 1 AS DOUBLE) DESC, m DESC, blended) - 1 AS demoted FROM bl),
cap AS (SELECT query_id, -1 AS f, list(position ORDER BY demoted) AS l FROM dm GROUP BY query_id
  UNION ALL SELECT query_id, f + 1, CASE WHEN list_contains(l, f + 1) THEN list_concat(list_concat(rest[1:t], [f + 1]), rest[t + 1:]) ELSE l END FROM (
    SELECT query_id, f, l, list_filter(l, lambda x: x <> f + 1) AS rest, least(f + 1 + 3, coalesce(list_position(l, f + 1), 1) - 1) AS t FROM cap WHERE f < 9)),
pl AS (SELECT x.query_id, dm.chunk_id, dm.position, x.place FROM (SELECT query_id, unnest(l) AS position, generate_subscripts(l, 1) - 1 AS place FROM cap WHERE f = 9) x JOIN dm ON dm.query_id = x.query_id AND dm.position = x.position),
c AS (SELECT query_id, chunk_id, position, place, version, strlen(text) AS bytes FROM pl JOIN dd USING (chunk_id) WHERE place < 30),
w3 AS (SELECT chunk_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM dd WHERE chunk_id IN (SELECT chunk_id FROM c)),
g3 AS (SELECT chunk_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) END) AS s FROM w3),
pr AS (SELECT DISTINCT x.chunk_id AS a, y.chunk_id AS b FROM c x JOIN c y ON x.query_id = y.query_id AND x.chunk_id < y.chunk_id AND x.version IS NOT DISTINCT FROM y.version),
jc AS (SELECT a, b, n / (t - n) AS s FROM (SELECT a, b, len(list_intersect(x.s, y.s)) AS n, len(x.s) + len(y.s) AS t FROM pr JOIN g3 x ON x.chunk_id = a JOIN g3 y ON y.chunk_id = b) WHERE n > 0),
sims AS (SELECT x.query_id, x.place AS a, y.place AS b, jc.s FROM c x JOIN c y ON x.query_id = y.query_id AND x.place <> y.place JOIN jc ON jc.a = least(x.chunk_id, y.chunk_id) AND jc.b = greatest(x.chunk_id, y.chunk_id)),
sel AS (SELECT DISTINCT query_id, 0 AS step, CAST([] AS BIGINT[]) AS chosen, CAST([] AS BIGINT[]) AS dropped, CAST(0 AS BIGINT) AS used FROM c
  UNION ALL SELECT query_id, step + 1, CASE WHEN fits THEN list_append(chosen, place) ELSE chosen END, CASE WHEN fits THEN dropped ELSE list_append(dropped, place) END, CAST(used + CASE WHEN fits THEN bytes ELSE 0 END AS BIGINT) FROM (
    SELECT *, used + bytes <= {BYTES} AS fits, row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 / (place + 1) - 0.3 * m, 12) DESC, place) AS r FROM (
      SELECT sel.query_id, sel.step, sel.chosen, sel.dropped, sel.used, c.place, c.bytes, coalesce(max(sims.s), 0) AS m FROM sel JOIN c ON c.query_id = sel.query_id AND NOT list_contains(sel.chosen, c.place) AND NOT list_contains(sel.dropped, c.place)
      LEFT JOIN sims ON sims.query_id = sel.query_id AND sims.a = c.place AND list_contains(sel.chosen, sims.b) WHERE len(sel.chosen) < 10 GROUP BY ALL)) WHERE r = 1),
ev AS (SELECT query_id, chunk_id, e.selected, position, place, version FROM (SELECT query_id, unnest(chosen) AS place, generate_subscripts(chosen, 1) - 1 AS selected FROM (SELECT query_id, arg_max(chosen, step) AS chosen FROM sel GROUP BY query_id)) e JOIN c USING (query_id, place))"""

_GAPS = f"""held AS (SELECT query_id, count(*) AS pooled FROM c GROUP BY 1), kept AS (SELECT query_id, count(*) AS kept FROM ev GROUP BY 1),
inside AS (SELECT wa.query_id, identifier, bool_or(ev.chunk_id IS NOT NULL) AS returned FROM wa JOIN c ON c.query_id = wa.query_id JOIN dd ON dd.chunk_id = c.chunk_id AND {_literal('dd.text')} LEFT JOIN ev ON ev.query_id = c.query_id AND ev.chunk_id = c.chunk_id GROUP BY 1, 2),
lost AS (SELECT wa.query_id, list('Required identifier "' || wa.identifier || '"' || CASE WHEN inside.identifier IS NOT NULL THEN ' was found in candidates but is absent after budgeting.' ELSE ' is absent from returned passages.' END ORDER BY wa.identifier) AS l
  FROM wa LEFT JOIN inside ON inside.query_id = wa.query_id AND inside.identifier = wa.identifier WHERE NOT coalesce(returned, false) GROUP BY 1),
asked AS (SELECT query_id, {I.found('text', 'version', D)}[1] AS version, {I.inventory_request('text', D)} IS NOT NULL AS inv FROM qs),
gp AS (SELECT asked.query_id, CASE WHEN kept IS NULL THEN [CASE WHEN inv THEN '{assembly.NO_PASSAGES}' ELSE '{assembly.NO_EVIDENCE}' END] ELSE [] END || coalesce(lost.l, [])
 || CASE WHEN version IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.query_id = asked.query_id AND ev.version = asked.version) THEN ['Requested version "' || version || '" is not represented in returned passages.'] ELSE [] END
 || CASE WHEN pooled > coalesce(kept, 0) THEN ['{assembly.OMITTED}'] ELSE [] END AS g FROM asked LEFT JOIN held USING (query_id) LEFT JOIN kept USING (query_id) LEFT JOIN lost USING (query_id))"""


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Passages and questions."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    text = F.coalesce("text", F.lit(""))
    rules = [(None, "SRC1", None, "official_docs"), (None, None, "src1", "community")]
    classed = retrieval.classify_sources(docs, rules, "source", "source", "source")
    passages = classed.select(F.col("doc_id").cast("string").alias("chunk_id"), text.alias("text"), "source_class", F.expr(f"get({I.found('coalesce(text, \"\")', 'version')}, 0)").alias("version"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "l")).where(F.size(F.expr(I.index_identifiers("l"))) > 0)
    first = lines.groupBy("doc_id").agg(F.min_by("l", "n").alias("l")).where(F.octet_length("l") <= retrieval.MOST_QUERY_BYTES)
    asked = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"), text.alias("text"))
    return passages, asked.unionByName(first.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("query_id"), F.col("l").alias("text")))


@query(f"WITH RECURSIVE {_SEARCH} SELECT query_id, chunk_id, selected, position, place, (SELECT array_to_string(list_sort(list(DISTINCT route)), ',') FROM hits WHERE hits.query_id = ev.query_id AND hits.chunk_id = ev.chunk_id) AS routes FROM ev")
def search_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question is answered from: the chosen passages with their places before and after the policies, and the routes that found them."""
    found = search.search(*_tables(spark, sf_dir), SETTINGS)
    return found.evidence.withColumn("routes", F.array_join("routes", ","))


@query(f"WITH RECURSIVE {_SEARCH}, {_GAPS} SELECT query_id, unnest(g) AS gap, generate_subscripts(g, 1) - 1 AS position FROM gp")
def search_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the evidence of each question is known to lack."""
    return search.search(*_tables(spark, sf_dir), SETTINGS).gaps

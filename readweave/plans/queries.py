"""The engine's queries over the derived views, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import barcodes as B
from ..functions import fuzzy as Z
from ..functions import positions as P
from ..functions import registry as G
from ..operators import bundles as R
from ..operators import clustering as K
from ..operators import extraction as X
from ..operators import molecules as M
from ..operators import pairing as J
from ..operators import statistics as S
from ..operators import whitelist as L
from ..sources import alignments as A
from ..sources import fastq as Q
from ..streaming import bundles as T
from .fixtures import duck, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


KEYS = ["contig", "pos"]


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.umi_counts(view(spark, sf_dir, "reads"), KEYS)


# --- clusters -------------------------------------------------------------------------------------------------------

C = f"WITH RECURSIVE {duck('reads')},\nc AS (SELECT contig, pos, umi, count(*) AS n, min(ord) AS f FROM reads GROUP BY ALL)"
RANKED = """,
k AS (SELECT *, row_number() OVER (PARTITION BY contig, pos ORDER BY n DESC, f) - 1 AS rk,
  row_number() OVER (PARTITION BY contig, pos ORDER BY n DESC, umi) - 1 AS tr FROM c),
e AS (SELECT a.contig, a.pos, a.umi AS a, b.umi AS b, a.n AS na, b.n AS nb, a.tr AS ta FROM k a JOIN k b
  ON a.contig = b.contig AND a.pos = b.pos AND a.umi <> b.umi AND hamming(a.umi, b.umi) <= 1)"""


def reach(rule: str) -> str:
    return f"""{RANKED},
reach(contig, pos, src, dst) AS (SELECT contig, pos, umi, umi FROM c UNION
  SELECT r.contig, r.pos, r.src, e.b FROM reach r JOIN e ON e.contig = r.contig AND e.pos = r.pos AND e.a = r.dst{rule}),
g AS (SELECT r.contig, r.pos, r.dst AS umi, min(k.rk) AS grp FROM reach r JOIN k ON k.contig = r.contig AND k.pos = r.pos AND k.umi = r.src GROUP BY ALL),
m AS (SELECT k.*, g.grp FROM k JOIN g USING (contig, pos, umi))"""


DIRECTIONAL = C + reach(" AND e.na >= 2 * e.nb - 1")
CLUSTER = C + reach("")
LABELLED = "SELECT contig, pos, umi, n, arg_min(umi, tr) OVER w AS final_umi, (sum(n) OVER w)::BIGINT AS group_n FROM m WINDOW w AS (PARTITION BY contig, pos, grp)"


def labelled(spark: SparkSession, sf_dir: str, method: str, plan: str = "auto") -> DataFrame:
    return K.cluster_umis(counts(spark, sf_dir), KEYS, method, 1, plan).select(*KEYS, "umi", "n", "final_umi", "group_n")


@query(f"{C} SELECT contig, pos, umi, n, f AS first_ord FROM c")
def umi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(spark, sf_dir).select(*KEYS, "umi", "n", "first_ord")


@query(f"{C}{RANKED} SELECT contig, pos, a, b FROM e WHERE na >= 2 * nb - 1")
def near_umis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directional edges by block join."""
    return K._near_pairs(counts(spark, sf_dir), KEYS, 1).where("n_a >= 2 * n_b - 1").select(*KEYS, "a", "b")


@query(f"{DIRECTIONAL} {LABELLED}")
def cluster_directional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir, "directional")


@query(f"{DIRECTIONAL} {LABELLED}")
def cluster_directional_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir, "directional", "frames")


@query(f"{CLUSTER} {LABELLED}")
def cluster_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir, "cluster")


ADJACENCY = f"""{CLUSTER},
l AS (SELECT m.*, least(tr, (SELECT min(ta) FROM e WHERE e.contig = m.contig AND e.pos = m.pos AND e.b = m.umi)) AS mu FROM m),
x AS (SELECT *, max(mu) OVER (PARTITION BY contig, pos, grp) AS top FROM l),
y AS (SELECT *, CASE WHEN tr <= top THEN tr ELSE mu END AS lead FROM x)
SELECT contig, pos, umi, n, max(CASE WHEN tr = lead THEN umi END) OVER w AS final_umi, (sum(n) OVER w)::BIGINT AS group_n FROM y WINDOW w AS (PARTITION BY contig, pos, grp, lead)"""


@query(ADJACENCY)
def cluster_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir, "adjacency")


@query(ADJACENCY)
def cluster_adjacency_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir, "adjacency", "frames")


@query(f"{C} SELECT contig, pos, umi, n, umi AS final_umi, n AS group_n FROM c")
def cluster_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir, "unique")


@query(f"{C} SELECT contig, pos, umi, n, umi AS final_umi, n AS group_n FROM c QUALIFY n > median(n) OVER (PARTITION BY contig, pos) / 100 OR count(*) OVER (PARTITION BY contig, pos) = 1")
def cluster_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir, "percentile")


@query(f"{C}, p AS (SELECT contig, pos, count(*) AS m FROM c GROUP BY ALL) SELECT count(*) AS positions, sum(m)::BIGINT AS total_umis, max(m) AS max_umis, avg(m) AS mean_umis FROM p")
def cluster_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.counters(K.cluster_umis(counts(spark, sf_dir), KEYS), KEYS)


# --- bundles and triage ---------------------------------------------------------------------------------------------

AL = f"WITH RECURSIVE {duck('alignments')}"
PA = f"WITH {duck('paired')}"


@query(
    f"""{AL}, t AS (SELECT *, flag & 128 = 128 AS r2, flag & 4 = 4 AS un FROM alignments WHERE rname IS NOT NULL),
i AS (SELECT * FROM t WHERE NOT r2), s AS (SELECT * FROM i WHERE NOT un), q AS (SELECT * FROM s WHERE mapq >= 10)
SELECT 'Input Reads' AS event, count(*) AS n FROM i UNION ALL SELECT 'Single end unmapped', count(*) FROM i WHERE un
UNION ALL SELECT '< MAPQ threshold', count(*) FROM s WHERE mapq < 10 UNION ALL SELECT 'Read skipped, no tag', count(*) FROM q WHERE t_xf IS NULL
UNION ALL SELECT 'Read skipped - gene string is empty', count(*) FROM q WHERE t_xf = ''
UNION ALL SELECT 'Read skipped - assigned tag matches skip_regex', count(*) FROM q WHERE t_xf = 'Unassigned'"""
)
def triage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = R.BundleOptions(extract_method="tag", per_gene=True, gene_tag="XF", mapping_quality=10)
    return R.event_counts(R.triage(view(spark, sf_dir, "alignments"), o))


@query(
    f"""{PA}, i AS (SELECT *, flag & 1 = 1 AS pair, flag & 4 = 4 AS un, flag & 8 = 8 AS mu FROM paired WHERE flag & 128 = 0),
s AS (SELECT * FROM i WHERE pair AND NOT un), v AS (SELECT * FROM s WHERE NOT mu)
SELECT 'Input Reads' AS event, count(*) AS n FROM i UNION ALL SELECT 'Read pairs', count(*) FROM i WHERE pair UNION ALL SELECT 'Unpaired reads', count(*) FROM i WHERE NOT pair
UNION ALL SELECT 'Read 1 unmapped', count(*) FROM i WHERE pair AND un HAVING count(*) > 0 UNION ALL SELECT 'Read 2 unmapped', count(*) FROM s WHERE mu
UNION ALL SELECT 'Chimeric read pair', count(*) FROM v WHERE rname <> mate_rname"""
)
def triage_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = R.BundleOptions(paired=True, unpaired_reads="discard", chimeric_pairs="discard")
    return R.event_counts(R.triage(view(spark, sf_dir, "paired"), o))


@query(
    f"""{AL} SELECT ord, flag & 128 = 128 OR flag & 4 = 4 AS single, flag & 132 = 0 AS bundled FROM alignments"""
)
def triage_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What passes through and what is bundled when unmapped and second reads are returned."""
    t = R.triage(view(spark, sf_dir, "alignments"), R.BundleOptions(), return_read2=True, return_unmapped=True)
    return t.select("ord", "single", "bundled")


POSITION = """CASE WHEN flag & 16 = 16 THEN pos + CASE cigar WHEN '20M100N30M' THEN 150 WHEN '5S45M' THEN 45 WHEN '10M5I35M' THEN 45 ELSE 50 END
 ELSE pos - CASE cigar WHEN '5S45M' THEN 5 ELSE 0 END END"""
SPLICE = """CASE WHEN flag & 16 = 16 THEN CASE cigar WHEN '20M100N30M' THEN 30 WHEN '5S45M' THEN 45 ELSE 0 END
 ELSE CASE cigar WHEN '20M100N30M' THEN 20 WHEN '45M5S' THEN 45 ELSE 0 END END"""


@query(f"{AL} SELECT ord, {POSITION} AS position, {SPLICE} AS is_spliced, CASE WHEN flag & 16 = 16 THEN pos ELSE {POSITION} END AS start FROM alignments")
def read_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = P.read_position(F.col("pos"), F.col("cigar"), F.col("flag"))
    return view(spark, sf_dir, "alignments").select("ord", at.alias("at")).select("ord", F.col("at.pos").alias("position"), F.col("at.is_spliced").cast("int").alias("is_spliced"), "at.start")


BUNDLED = f"""b AS (SELECT ord, qname, rname AS contig, {POSITION} AS position, (flag & 16) // 16 AS is_reverse, {SPLICE} AS spliced, length(seq) AS length_key,
 t_rx AS umi, mapq, t_nh, t_xt, group_cell AS cell FROM (SELECT *, split_part(t_cb, '-', 1) AS group_cell FROM alignments WHERE rname IS NOT NULL AND flag & 132 = 0))"""


@query(f"{AL}, {BUNDLED} SELECT contig, position, is_reverse, spliced, length_key, cell, umi, count(*) AS n, min(ord) AS first_ord FROM b GROUP BY ALL")
def bundle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles by position, strand, splice, read length and cell."""
    o = R.BundleOptions(extract_method="tag", cell_tag="CB", per_cell=True, spliced=True, read_length=True)
    keyed = R.bundle_keys(R.triage(view(spark, sf_dir, "alignments"), o), o)
    return R.umi_counts(keyed).select("contig", "position", F.col("is_reverse").cast("int").alias("is_reverse"), F.col("spliced").cast("int").alias("spliced"), "length_key", "cell", "umi", "n", "first_ord")


@query(f"{AL}, {BUNDLED} SELECT ord, umi FROM b QUALIFY row_number() OVER (PARTITION BY contig, position, is_reverse, umi ORDER BY mapq DESC, t_nh::INT, ord) = 1")
def best_reads_by_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = R.BundleOptions(extract_method="tag", detection_method="NH")
    keyed = R.bundle_keys(R.triage(view(spark, sf_dir, "alignments"), o), o)
    return R.best_reads(keyed, o, tie="ord").select("ord", "umi")


@query(f"{AL}, {BUNDLED} SELECT ord, umi FROM b QUALIFY row_number() OVER (PARTITION BY contig, position, is_reverse, umi ORDER BY mapq DESC, t_xt = 'U' DESC, ord) = 1")
def best_reads_by_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = R.BundleOptions(extract_method="tag", detection_method="XT")
    keyed = R.bundle_keys(R.triage(view(spark, sf_dir, "alignments"), o), o)
    return R.best_reads(keyed, o, tie="ord").select("ord", "umi")


TOP = "t AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY contig, position, is_reverse, umi) AS k FROM (SELECT * FROM b QUALIFY mapq = max(mapq) OVER (PARTITION BY contig, position, is_reverse, umi)) WINDOW w AS (PARTITION BY contig, position, is_reverse, umi ORDER BY ord))"


@query(f"{AL}, {BUNDLED}, {TOP} SELECT contig, position, umi, is_reverse, CASE WHEN k = 1 THEN min(ord) WHEN k = 2 THEN max(ord) END AS ord, true AS allowed FROM t GROUP BY contig, position, umi, is_reverse, k")
def best_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties by the default rule: the only read that may stay, or whether the one that stays is not the first."""
    o = R.BundleOptions(extract_method="tag")
    keyed = R.bundle_keys(R.triage(view(spark, sf_dir, "alignments"), o), o)
    whole = Window.partitionBy(*R.KEYS, "umi")
    top = keyed.withColumn("m", F.max("mapq").over(whole)).where("mapq = m").withColumns({"k": F.count(F.lit(1)).over(whole), "early": F.min("ord").over(whole)})
    out = R.best_reads(keyed, o).select("ord", "contig", "position", "umi", F.col("is_reverse").cast("int").alias("is_reverse")).join(top.select("ord", "k", "early"), "ord")
    return out.select("contig", "position", "umi", "is_reverse", F.when(F.col("k") <= 2, F.col("ord")).alias("ord"), ((F.col("k") == 1) | (F.col("ord") != F.col("early"))).alias("allowed"))


@query(f"{AL}, {BUNDLED}, {TOP} SELECT contig, position, umi, is_reverse, coalesce(min(ord) FILTER (t_xt = 'U'), CASE WHEN k = 1 THEN min(ord) WHEN k = 2 THEN max(ord) END) AS ord FROM t GROUP BY contig, position, umi, is_reverse, k HAVING k <= 2 OR bool_or(t_xt = 'U')")
def best_reads_first_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XT with ties by the default rule, where one read only may stay."""
    o = R.BundleOptions(extract_method="tag", detection_method="XT")
    keyed = R.bundle_keys(R.triage(view(spark, sf_dir, "alignments"), o), o)
    whole = Window.partitionBy(*R.KEYS, "umi")
    top = keyed.withColumn("m", F.max("mapq").over(whole)).where("mapq = m").withColumns({"k": F.count(F.lit(1)).over(whole), "u": F.max(F.col("tags")["XT"] == "U").over(whole)})
    out = R.best_reads(keyed, o).join(top.where("k <= 2 or u").select("ord"), "ord", "left_semi")
    return out.select("contig", "position", "umi", F.col("is_reverse").cast("int").alias("is_reverse"), "ord")


@query(f"{AL} SELECT tag, bool_and(present) AS present FROM (SELECT unnest(['NH', 'XT', 'XF']) AS tag, unnest([t_nh IS NOT NULL, t_xt IS NOT NULL, t_xf IS NOT NULL]) AS present FROM (SELECT * FROM alignments ORDER BY ord LIMIT 1001) WHERE flag & 4 = 0) GROUP BY tag")
def tag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.detect_features(view(spark, sf_dir, "alignments"), ("NH", "XT", "XF"))


@query(f"{AL} SELECT ord, split_part(qname, '_', 3) AS umi, split_part(qname, '_', 2) AS cell, t_rx AS tag_umi, split_part(t_cb, '-', 1) AS tag_cell FROM alignments")
def barcodes_of_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell, umi = B.barcode_from_name(F.col("qname"), per_cell=True)
    tag_cell, tag_umi = B.barcode_from_tags(F.col("tags"), "RX", "CB", per_cell=True)
    return view(spark, sf_dir, "alignments").select("ord", umi.alias("umi"), cell.alias("cell"), tag_umi.alias("tag_umi"), tag_cell.alias("tag_cell"))


# --- molecules ------------------------------------------------------------------------------------------------------

GROUPED = f"""{AL}, {BUNDLED}, c AS (SELECT contig, position * 2 + is_reverse AS pos, umi, count(*) AS n, min(ord) AS f FROM b GROUP BY ALL)""" + reach(" AND e.na >= 2 * e.nb - 1")
TOPS = ", tops AS (SELECT contig, pos, umi, (sum(n) OVER w)::BIGINT AS group_n FROM m WINDOW w AS (PARTITION BY contig, pos, grp) QUALIFY arg_min(umi, tr) OVER w = umi)"
BEST = ", best AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY contig, position, is_reverse, umi ORDER BY mapq DESC, ord) = 1)"


@query(f"{GROUPED}{TOPS}{BEST} SELECT ord, qname, best.umi, group_n FROM best JOIN tops ON tops.contig = best.contig AND tops.pos = position * 2 + is_reverse AND tops.umi = best.umi")
def dedup_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = R.BundleOptions(extract_method="tag")
    return M.dedup(view(spark, sf_dir, "alignments"), o, tie="ord").select("ord", "qname", "umi", "group_n")


@query(f"{GROUPED}{TOPS}{BEST} SELECT ord, best.umi FROM best JOIN tops ON tops.contig = best.contig AND tops.pos = position * 2 + is_reverse AND tops.umi = best.umi WHERE best.umi LIKE 'A%'")
def dedup_whitelisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = view(spark, sf_dir, "alignments")
    listed = view(spark, sf_dir, "reads").where("umi like 'A%'").select("umi").distinct()
    return M.dedup(reads, R.BundleOptions(extract_method="tag"), tie="ord", umi_whitelist=listed).select("ord", "umi")


@query(
    f"""{PA}, k AS (SELECT * FROM paired WHERE flag & 128 = 0 AND flag & 12 = 0),
w AS (SELECT DISTINCT qname, mate_rname AS rname, mate_pos AS pos FROM k)
SELECT p.ord, p.qname FROM paired p SEMI JOIN w ON p.qname = w.qname AND p.rname = w.rname AND p.pos = w.pos WHERE flag & 12 = 0 AND flag & 64 = 0
QUALIFY row_number() OVER (PARTITION BY p.qname, p.rname, p.pos ORDER BY p.ord) = 1"""
)
def mate_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = view(spark, sf_dir, "paired")
    return M.mates(reads, reads.where("flag & 128 = 0")).select("ord", "qname")


NUMBERED = f"""{GROUPED}, h AS (SELECT *, row_number() OVER (ORDER BY contig, pos // 2, pos % 2, grp) - 1 AS unique_id FROM (SELECT DISTINCT contig, pos, grp FROM m)),
l AS (SELECT m.contig, m.pos, m.umi, n AS umi_count, arg_min(umi, tr) OVER w AS final_umi, (sum(n) OVER w)::BIGINT AS final_umi_count, unique_id FROM m JOIN h USING (contig, pos, grp) WINDOW w AS (PARTITION BY m.contig, m.pos, m.grp))"""


@query(
    f"""{NUMBERED} SELECT qname AS read_id, b.contig, position, 'NA' AS gene, b.umi, umi_count, final_umi, final_umi_count, unique_id
FROM b JOIN l ON l.contig = b.contig AND l.pos = position * 2 + is_reverse AND l.umi = b.umi"""
)
def group_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.label(view(spark, sf_dir, "alignments"), R.BundleOptions(extract_method="tag"))[1]


@query(f"{NUMBERED} SELECT ord, unique_id::VARCHAR AS ug, final_umi AS bx FROM b JOIN l ON l.contig = b.contig AND l.pos = position * 2 + is_reverse AND l.umi = b.umi UNION ALL SELECT ord, NULL, NULL FROM alignments WHERE rname IS NOT NULL AND flag & 128 = 128")
def group_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.label(view(spark, sf_dir, "alignments"), R.BundleOptions(extract_method="tag"))[0]
    return out.select("ord", F.col("tags")["UG"].alias("ug"), F.col("tags")["BX"].alias("bx"))


GENES = f"""{AL}, r AS (SELECT ord, rname AS contig, t_xf AS pos, t_rx AS umi, split_part(t_cb, '-', 1) AS cell FROM alignments
 WHERE rname IS NOT NULL AND flag & 132 = 0 AND t_xf IS NOT NULL AND t_xf NOT IN ('', 'Unassigned')), c AS (SELECT contig, pos, umi, count(*) AS n, min(ord) AS f FROM r GROUP BY ALL)""" + reach(" AND e.na >= 2 * e.nb - 1")


@query(f"{GENES} SELECT pos AS gene, count(DISTINCT grp) AS count FROM m GROUP BY contig, pos")
def count_per_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules per gene (and contig): the flagship query."""
    o = R.BundleOptions(extract_method="tag", per_gene=True, gene_tag="XF")
    return M.count_genes(view(spark, sf_dir, "alignments"), o)


CELLS = GENES.replace("t_xf AS pos", "t_xf || '|' || split_part(t_cb, '-', 1) AS pos")
PER_CELL = f"{CELLS}, n AS (SELECT contig, pos, count(DISTINCT grp) AS k FROM m GROUP BY contig, pos), z AS (SELECT split_part(pos, '|', 1) AS gene, split_part(pos, '|', 2) AS cell, arg_max(k, contig) AS count FROM n GROUP BY ALL)"


@query(f"{PER_CELL} SELECT gene, cell, count FROM z")
def count_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = R.BundleOptions(extract_method="tag", per_gene=True, gene_tag="XF", per_cell=True, cell_tag="CB")
    return M.count_genes(view(spark, sf_dir, "alignments"), o)


ALL_CELLS = [a + b for a in "ACGT" for b in "ACGT"]


@query(f"{PER_CELL} SELECT gene, " + ", ".join(f"coalesce(max(count) FILTER (cell = '{c}'), 0) AS \"{c}\"" for c in ALL_CELLS) + " FROM z GROUP BY gene")
def count_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.wide_counts(count_per_cell(spark, sf_dir), ALL_CELLS)


TAB = f"""WITH RECURSIVE {duck('reads')}, t AS (SELECT *, gene <> coalesce(lag(gene) OVER (ORDER BY ord), '-') AS new FROM reads),
r AS (SELECT *, sum(new::INT) OVER (ORDER BY ord) AS run FROM t)"""
TAB_GROUPS = f"{TAB}, c AS (SELECT run::VARCHAR AS contig, gene AS pos, umi, count(*) AS n, min(ord) AS f FROM r GROUP BY ALL)" + reach(" AND e.na >= 2 * e.nb - 1")


def gene_table(spark: SparkSession, sf_dir: str, *, ordered: bool) -> DataFrame:
    reads = view(spark, sf_dir, "reads")
    ord_ = F.row_number().over(Window.orderBy("gene", "ord")).cast("long") if ordered else F.col("ord")
    return reads.select(ord_.alias("ord"), F.concat_ws("_", F.lit("r"), "cell", "umi").alias("read_id"), "gene")


@query(f"{TAB_GROUPS} SELECT pos AS gene, count(DISTINCT grp) AS count FROM m GROUP BY contig, pos")
def count_table_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is not sorted by gene: every run of a gene is counted."""
    return M.count_table(gene_table(spark, sf_dir, ordered=False))


@query(
    f"WITH RECURSIVE {duck('reads')}, c AS (SELECT cell AS contig, gene AS pos, umi, count(*) AS n, min(ord) AS f FROM reads GROUP BY ALL)"
    + reach(" AND e.na >= 2 * e.nb - 1")
    + " SELECT contig AS cell, pos AS gene, count(DISTINCT grp) AS count FROM m GROUP BY contig, pos"
)
def count_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.count_table(gene_table(spark, sf_dir, ordered=True), per_cell=True)


@query(f"{TAB} SELECT ord, gene, (run - 1)::BIGINT AS run FROM r")
def gene_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.gene_runs(view(spark, sf_dir, "reads").select("ord", "gene")).select("ord", "gene", "run")


@query(
    f"""{AL}, t(gene, gene_ord, transcript) AS (VALUES ('GA', 0, 'click'), ('GA', 0, 'view'), ('GB', 1, 'view'), ('GB', 1, 'error')),
l AS (SELECT transcript, arg_max(gene, gene_ord) AS g FROM t GROUP BY ALL)
SELECT g AS gene, count(*) AS n, count(DISTINCT t_rx) AS umis FROM alignments JOIN t ON t.transcript = rname JOIN l USING (transcript) WHERE flag & 132 = 0 GROUP BY g"""
)
def transcript_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles by gene over a map of genes to contigs; a contig of two genes is read for both."""
    pairs = spark.createDataFrame([("GA", 0, "click"), ("GA", 0, "view"), ("GB", 1, "view"), ("GB", 1, "error")], "gene string, gene_ord long, transcript string")
    o = R.BundleOptions(extract_method="tag", per_gene=True, per_contig=True, transcripts=pairs)
    keyed = R.bundle_keys(R.triage(view(spark, sf_dir, "alignments"), o), o)
    return keyed.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("umi").alias("umis"))


@query(f"{AL} SELECT ord, row_number() OVER (ORDER BY rname NULLS LAST, pos, flag & 16, ord) AS place FROM alignments")
def sorted_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = M.sorted_alignments(view(spark, sf_dir, "alignments").select("ord", "rname", "pos", "flag"))
    return ordered.select("ord", "rname", "pos", "flag").withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("rname"), "pos", P.has(F.col("flag"), "reverse"), "ord")).cast("long")).select("ord", "place")


# --- statistics -----------------------------------------------------------------------------------------------------

POST = f"{DIRECTIONAL}, post AS (SELECT contig, pos, umi, (sum(n) OVER w)::BIGINT AS n FROM m WINDOW w AS (PARTITION BY contig, pos, grp) QUALIFY arg_min(umi, tr) OVER w = umi)"


def before_after(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    groups = K.cluster_umis(counts(spark, sf_dir), KEYS)
    return groups.select(*KEYS, "umi", "n"), S.kept_counts(groups, KEYS)


@query(
    f"""{POST}, a AS (SELECT n AS counts, count(*) AS i FROM c GROUP BY n), b AS (SELECT n AS counts, count(*) AS i FROM post GROUP BY n)
SELECT counts, coalesce(a.i, 0) AS instances_pre, coalesce(b.i, 0) AS instances_post FROM a FULL JOIN b USING (counts)"""
)
def stats_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.count_histogram(*before_after(spark, sf_dir))


def _side(table: str, when: str) -> str:
    return f"SELECT umi AS UMI, floor(median(n))::BIGINT AS median_counts_{when}, count(*) AS times_observed_{when}, sum(n)::BIGINT AS total_counts_{when} FROM {table} GROUP BY umi"


@query(
    f"""{POST}, a AS ({_side("c", "pre")}), b AS ({_side("post", "post")}) SELECT a.*, coalesce(median_counts_post, 0) AS median_counts_post,
coalesce(times_observed_post, 0) AS times_observed_post, coalesce(total_counts_post, 0) AS total_counts_post FROM a LEFT JOIN b USING (UMI)"""
)
def stats_umis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.per_umi(*before_after(spark, sf_dir))


def _distances(table: str) -> str:
    return f"(SELECT a.contig, a.pos, ceil(avg(hamming(a.umi, b.umi)))::BIGINT AS bin FROM {table} a JOIN {table} b ON a.contig = b.contig AND a.pos = b.pos AND a.umi < b.umi GROUP BY ALL UNION ALL SELECT contig, pos, -1 FROM {table} GROUP BY ALL HAVING count(*) = 1)"


@query(
    f"""{POST}, x AS {_distances("c")}, y AS {_distances("post")}, r AS (SELECT unnest(range(-1, 1 + greatest((SELECT max(bin) FROM x), (SELECT max(bin) FROM y), 0))) AS bin)
SELECT (SELECT count(*) FROM x WHERE x.bin = r.bin) AS "unique", (SELECT count(*) FROM y WHERE y.bin = r.bin) AS directional,
CASE WHEN bin = -1 THEN 'Single_UMI' ELSE bin::VARCHAR END AS edit_distance FROM r"""
)
def stats_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    pre, post = before_after(spark, sf_dir)
    return S.distance_bins({"unique": S.mean_distance(pre, KEYS), "directional": S.mean_distance(post, KEYS)})


@query()
def stats_random_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with UMIs drawn at random by their frequency."""
    pre, post = before_after(spark, sf_dir)
    by_umi = counts(spark, sf_dir).groupBy("umi").agg(F.sum("n").alias("n"), F.min("first_ord").alias("first_ord"))
    drawn = {name: S.mean_distance(S.sampled_umis(df, by_umi, KEYS), KEYS) for name, df in (("unique_null", pre), ("directional_null", post))}
    return S.distance_bins(drawn)


@query(
    f"""{AL}, k AS (SELECT t_rx AS umi, count(*) AS n, min(ord) AS first_ord FROM alignments WHERE rname IS NOT NULL AND flag & 132 = 0 GROUP BY ALL)
SELECT umi, n, first_ord, sum(n) OVER (ORDER BY first_ord) / (SELECT sum(n) FROM k) AS cdf FROM k"""
)
def umi_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.umi_histogram(view(spark, sf_dir, "alignments"), R.BundleOptions(extract_method="tag"))


# --- pairs ----------------------------------------------------------------------------------------------------------


@query(
    f"""{PA}, t AS (SELECT *, flag & 64 = 64 AS is1, flag & 256 = 256 AS sec, sum(new::INT) OVER (ORDER BY ord) AS tpl FROM (SELECT *, qname <> coalesce(lag(qname) OVER (ORDER BY ord), '') AS new FROM paired)),
j AS (SELECT r.ord AS r, m.ord AS m, r.is1, r.flag & 128 = 128 AS is2, r.sec AS rsec, r.sec = NOT m.sec AS fits, m.mate_rname = r.rname AND m.mate_pos = r.pos AS back
 FROM t r JOIN t m ON r.tpl = m.tpl AND r.is1 <> m.is1 AND r.mate_rname = m.rname AND r.mate_pos = m.pos),
p AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY r ORDER BY fits DESC, back DESC, CASE WHEN back THEN m ELSE -m END DESC) = 1),
o AS (SELECT r, CASE WHEN is1 THEN r ELSE m END AS one, CASE WHEN is1 THEN m ELSE r END AS two, is1, rsec FROM p WHERE is1 OR is2),
f AS (SELECT o.*, a.flag | CASE WHEN NOT o.is1 AND rsec THEN 256 ELSE 0 END AS f1, b.flag | CASE WHEN o.is1 AND rsec THEN 256 ELSE 0 END AS f2, a.t_rx AS bx FROM o JOIN t a ON a.ord = one JOIN t b ON b.ord = two),
u AS (SELECT min(r) AS pair_ord, one, two, f1, f2, min(bx) AS bx FROM f GROUP BY one, two, f1, f2)
SELECT pair_ord, 1 AS side, one AS ord, f1 AS flag, bx AS rx FROM u UNION ALL SELECT pair_ord, 2, two, f2, bx FROM u"""
)
def prepared_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.prepare_pairs(view(spark, sf_dir, "paired"), tags=("RX",)).select("pair_ord", "side", "ord", "flag", F.col("tags")["RX"].alias("rx"))


# --- raw reads ------------------------------------------------------------------------------------------------------

FQ = f"WITH {duck('fastq')}"


def raw_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fastq").select("ord", F.struct("identifier", "seq", "quals").alias("read1"))


def flat(out: DataFrame) -> DataFrame:
    return out.select("ord", "cell", "umi", "umi_quals", "kept", "read1.identifier", "read1.seq", "read1.quals")


NAME = "split_part(identifier, ' ', 1) || '_' || {cell}{umi} || substr(identifier, instr(identifier, ' '))"
PLAIN = f"SELECT ord, substr(seq, 1, 2) AS cell, substr(seq, 3, 5) AS umi, substr(quals, 3, 5) AS umi_quals, true AS kept, {NAME.format(cell='substr(seq, 1, 2) || chr(95) || ', umi='substr(seq, 3, 5)')} AS identifier, substr(seq, 8) AS seq, substr(quals, 8) AS quals FROM fastq"


@query(f"{FQ} {PLAIN}")
def extract_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(X.extract(raw_reads(spark, sf_dir), X.ExtractOptions("CCNNNNN")))


@query(
    f"{FQ} SELECT ord, '' AS cell, substr(seq, 36, 3) AS umi, substr(quals, 36, 3) AS umi_quals, true AS kept, {NAME.format(cell='', umi='substr(seq, 36, 3)')} AS identifier, "
    "substr(seq, 1, 35) || substr(seq, 39, 2) AS seq, substr(quals, 1, 35) || substr(quals, 39, 2) AS quals FROM fastq"
)
def extract_three_prime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(X.extract(raw_reads(spark, sf_dir), X.ExtractOptions("NNNXX", three_prime=True)))


@query(f"{FQ} {PLAIN}")
def extract_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(X.extract(raw_reads(spark, sf_dir), X.ExtractOptions("(?P<cell_1>.{2})(?P<umi_1>.{5})", method="regex")))


@query(
    f"""{FQ}, m AS (SELECT *, substr(seq, 1, 2) AS c, substr(seq, 3, 5) AS u, hamming(substr(seq, 8, 3), 'ACG') <= 1 AS ok FROM fastq)
SELECT ord, ok AS kept, CASE WHEN ok THEN u ELSE '' END AS umi, CASE WHEN ok THEN substr(seq, 11) ELSE seq END AS seq FROM m"""
)
def extract_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An anchor with one substitution after the barcodes."""
    o = X.ExtractOptions("(?P<cell_1>.{2})(?P<umi_1>.{5})(?P<discard_1>ACG){s<=1}", method="regex")
    return flat(X.extract(raw_reads(spark, sf_dir), o)).select("ord", "kept", "umi", "seq")


LOW = "list_min([ascii(q) - 33 FOR q IN string_split(substr(quals, 3, 5), '')]) < {n}"
MASKED = "list_aggregate([CASE WHEN ascii(substr(quals, 2 + i, 1)) - 33 < 12 THEN 'N' ELSE substr(seq, 2 + i, 1) END FOR i IN range(1, 6)], 'string_agg', '')"


@query(f"{FQ} SELECT ord, NOT ({LOW.format(n=8)}) AS kept, {MASKED} AS umi FROM fastq")
def extract_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.ExtractOptions("CCNNNNN", quality_filter_threshold=8, quality_filter_mask=12)
    return X.extract(raw_reads(spark, sf_dir), o).select("ord", "kept", "umi")


CELL_LISTS = "w(cell) AS (VALUES ('AA'), ('CC'), ('GG'), ('TT')), f(error, barcode) AS (VALUES ('AC', 'AA'), ('CA', 'CC'), ('GA', 'GG')), k(cell) AS (VALUES ('TT'), ('GG'))"


@query(
    f"""{FQ}, {CELL_LISTS}, x AS (SELECT ord, substr(seq, 1, 2) AS c FROM fastq), y AS (SELECT x.*, c IN (SELECT cell FROM k) AS black, c IN (SELECT cell FROM w) AS known, f.barcode FROM x LEFT JOIN f ON f.error = c)
SELECT ord, NOT black AND (known OR barcode IS NOT NULL) AND coalesce(barcode, c) NOT IN (SELECT cell FROM k) AS kept, CASE WHEN known OR barcode IS NULL THEN c ELSE barcode END AS cell FROM y"""
)
def extract_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell whitelist with corrections and a blacklist."""
    one = lambda *c: spark.createDataFrame([(x,) for x in c], "barcode string")
    fixes = spark.createDataFrame([("AC", "AA"), ("CA", "CC"), ("GA", "GG")], "error string, barcode string")
    cells = X.Lookup("cell", one("AA", "CC", "GG", "TT"), fixes, one("TT", "GG"))
    return X.extract(raw_reads(spark, sf_dir), X.ExtractOptions("CCNNNNN"), cells=cells).select("ord", "kept", "cell")


UMI_LISTS = "w(umi) AS (VALUES ('AAAAA'), ('CCCCC'), ('ACGTA')), d AS (SELECT umi, i, unnest(string_split('ACGTN', '')) AS b FROM w, (SELECT unnest(range(1, 6)) AS i)), x AS (SELECT umi, substr(umi, 1, i - 1) || b || substr(umi, i + 1) AS error FROM d WHERE substr(umi, i, 1) <> b), f AS (SELECT error, CASE WHEN count(*) = 1 THEN min(umi) END AS barcode FROM x GROUP BY error)"


@query(
    f"""{FQ}, {UMI_LISTS}, y AS (SELECT ord, substr(seq, 3, 5) AS u FROM fastq), z AS (SELECT y.*, u IN (SELECT umi FROM w) AS known, f.barcode, f.error FROM y LEFT JOIN f ON f.error = u),
v AS (SELECT CASE WHEN known THEN NULL WHEN barcode IS NOT NULL THEN 'False UMI barcode. Error-corrected' WHEN error IS NOT NULL THEN 'False UMI barcode. Not correctable - within threshold to more than one whitelisted UMI'
 ELSE 'False UMI barcode. Not correctable - not within threshold to whitelisted UMI' END AS event, known OR barcode IS NOT NULL AS kept FROM z)
SELECT event, count(*) AS n FROM (SELECT 'Input Reads' AS event FROM v UNION ALL SELECT event FROM v WHERE event IS NOT NULL UNION ALL SELECT 'Reads output' FROM v WHERE kept) GROUP BY event"""
)
def extract_umi_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UMI whitelist with derived corrections: the log of events."""
    listed = spark.createDataFrame([("AAAAA",), ("CCCCC",), ("ACGTA",)], "barcode string")
    umis = X.Lookup("umi", listed, L.derive_errors(listed, 1))
    return X.read_events(X.extract(raw_reads(spark, sf_dir), X.ExtractOptions("CCNNNNN"), umis=umis))


@query(f"{FQ}, a AS (SELECT * FROM fastq WHERE ord % 2 = 0), b AS (SELECT * FROM fastq WHERE ord % 2 = 1) SELECT a.ord // 2 AS ord, substr(a.seq, 1, 2) AS cell, substr(b.seq, 1, 3) AS umi, substr(a.seq, 3) AS seq1, substr(b.seq, 4) AS seq2 FROM a JOIN b ON b.ord = a.ord + 1")
def extract_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcodes on both reads of a pair."""
    reads = view(spark, sf_dir, "fastq")
    side = lambda i: reads.where(f"ord % 2 = {i}").withColumn("ord", F.expr("ord div 2"))
    pairs = Q.join_pairs(side(0), side(1), check_names=False)
    out = X.extract(pairs, X.ExtractOptions("CC", "NNN"))
    return out.select("ord", "cell", "umi", F.col("read1.seq").alias("seq1"), F.col("read2.seq").alias("seq2"))


@query(f"{FQ} SELECT ord, identifier, 'ok' AS state FROM fastq WHERE ord % 3 <> 0")
def reconciled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = view(spark, sf_dir, "fastq")
    both = Q.reconcile_pairs(reads.where("ord % 3 <> 0"), reads)
    return both.select("ord", "read1.identifier", F.when(F.col("read1.seq") == F.col("read2.seq"), "ok").alias("state"))


@query(f"{FQ} SELECT ord, '@' || identifier || chr(10) || seq || chr(10) || '+' || chr(10) || quals AS record FROM fastq")
def fastq_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fastq").select("ord", Q.fastq_text(F.col("identifier"), F.col("seq"), F.col("quals")).alias("record"))


@query(
    f"""{AL} SELECT ord, concat_ws(chr(9), qname, flag, coalesce(rname, '*'), pos + 1, mapq, cigar, CASE WHEN rname IS NULL THEN '*' ELSE '=' END, mate_pos + 1, tlen, seq, '*', 'CB:Z:' || t_cb,
 'NH:Z:' || t_nh, 'RX:Z:' || t_rx, 'XF:Z:' || t_xf, 'XT:Z:' || t_xt) AS line FROM alignments"""
)
def sam_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sam_text(view(spark, sf_dir, "alignments"))


# --- cells ----------------------------------------------------------------------------------------------------------


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of four bases with uneven counts."""
    return view(spark, sf_dir, "reads").select("ord", F.concat("cell", F.substring("umi", 1, 2)).alias("cell"), "umi")


CODES = f"WITH {duck('reads')}, codes AS (SELECT ord, cell || substr(umi, 1, 2) AS cell, umi FROM reads), h AS (SELECT cell, count(*) AS n, min(ord) AS first_ord FROM codes GROUP BY cell)"


@query(f"{CODES} SELECT * FROM h")
def cell_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cell_histogram(codes(spark, sf_dir))


@query(f"{CODES} SELECT cell, count(DISTINCT umi) AS n, min(ord) AS first_ord FROM codes GROUP BY cell")
def cell_umis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cell_histogram(codes(spark, sf_dir), "umis")


@query(f"{CODES} SELECT *, row_number() OVER (ORDER BY n DESC, first_ord) - 1 AS rank FROM h")
def cell_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.most_common(L.cell_histogram(codes(spark, sf_dir)))


KNEE = f"""WITH RECURSIVE {CODES[5:]}, v AS (SELECT *, row_number() OVER (ORDER BY n DESC, first_ord) - 1 AS i, sum(n) OVER (ORDER BY n DESC, first_ord)::DOUBLE AS y FROM h),
z AS (SELECT i, y, (SELECT min(y) FROM v) AS y0 FROM v),
it(step, prev, idx) AS (SELECT 0, 0::BIGINT, (SELECT arg_max(i, round(abs((y - y0) * (SELECT max(i) FROM z) - i * ((SELECT max(y) FROM z) - y0)), 3)) FROM z)
 UNION ALL SELECT step + 1, idx, (SELECT arg_max(z.i, round(abs((z.y - z.y0) * e.xi - z.i * (e.ye - z.y0)), 3)) FROM z, (SELECT max(i) AS xi, max(y) AS ye FROM z WHERE i < 3 * it.idx) e WHERE z.i < 3 * it.idx)
 FROM it WHERE step < 100 AND prev <> idx)"""


@query(f"{KNEE} SELECT v.cell, v.n FROM v WHERE i <= (SELECT arg_max(idx, step) FROM it)")
def knee_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.find_cells(L.cell_histogram(codes(spark, sf_dir))).select("cell", "n")


@query(f"{CODES} SELECT cell, n FROM h WHERE n > (SELECT n FROM h ORDER BY n DESC LIMIT 1 OFFSET 20)")
def top_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.find_cells(L.cell_histogram(codes(spark, sf_dir)), cell_number=20).select("cell", "n")


@query()
def density_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.threshold_table(spark, L.cell_histogram(codes(spark, sf_dir)), "density")


NEAR = f"{CODES}, w AS (SELECT cell FROM h WHERE n > (SELECT n FROM h ORDER BY n DESC LIMIT 1 OFFSET 20)), j AS (SELECT h.cell AS error, count(*) AS k, min(w.cell) AS barcode FROM h JOIN w ON hamming(h.cell, w.cell) <= 1 WHERE h.cell NOT IN (SELECT cell FROM w) GROUP BY h.cell HAVING k = 1)"


@query(f"{NEAR} SELECT barcode, error FROM j")
def cell_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.near_whitelist(L.cell_histogram(codes(spark, sf_dir)), top_cells(spark, sf_dir))


@query(
    f"""{NEAR} SELECT w.cell AS barcode, coalesce(string_agg(j.error, ',' ORDER BY j.error), '') AS errors, min(a.n) AS n, coalesce(string_agg(b.n::VARCHAR, ',' ORDER BY j.error), '') AS error_counts
FROM w JOIN h a ON a.cell = w.cell LEFT JOIN j ON j.barcode = w.cell LEFT JOIN h b ON b.cell = j.error GROUP BY w.cell"""
)
def whitelist_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = L.cell_histogram(codes(spark, sf_dir))
    cells = top_cells(spark, sf_dir)
    return L.whitelist_table(histogram, cells, L.near_whitelist(histogram, cells))


@query(
    f"""{CODES}, w AS (SELECT *, row_number() OVER (ORDER BY n, first_ord) AS p FROM h WHERE n > (SELECT n FROM h ORDER BY n DESC LIMIT 1 OFFSET 20))
SELECT cell, n FROM w a WHERE NOT EXISTS (SELECT 1 FROM w b, (SELECT unnest(range(3, 6)) AS k) WHERE b.p > a.p AND k <= length(b.cell) AND levenshtein(a.cell, substr(b.cell, 1, k)) <= 1)"""
)
def cells_without_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = L.find_cells(L.cell_histogram(codes(spark, sf_dir)), cell_number=20)
    return L.errors_above(cells, 1)[0].select("cell", "n")


@query(f"WITH {UMI_LISTS} SELECT error, barcode FROM f")
def derived_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.derive_errors(spark.createDataFrame([("AAAAA",), ("CCCCC",), ("ACGTA",)], "barcode string"), 1)


@query("WITH w(o, b, e) AS (VALUES (0, 'AAAA', 'AAAC,AAAG'), (1, 'CCCC', 'CCCA,AAAG')) SELECT error, arg_max(b, o) AS barcode FROM (SELECT o, b, unnest(string_split(e, ',')) AS error FROM w) GROUP BY error")
def listed_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.listed_errors(spark.createDataFrame([(0, "AAAA", "AAAC,AAAG"), (1, "CCCC", "CCCA,AAAG")], "ord long, barcode string, errors string"))


@query("WITH a(o, x) AS (VALUES (0, 'AA'), (1, 'CC')), b(o, y) AS (VALUES (0, 'GG'), (1, 'TT'), (2, 'AC')) SELECT a.o * 3 + b.o AS ord, x || y AS barcode FROM a, b")
def product_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = lambda *v: spark.createDataFrame(list(enumerate(v)), "ord int, barcode string")
    return L.product_barcodes(make("AA", "CC"), make("GG", "TT", "AC"))


# --- scalar functions -----------------------------------------------------------------------------------------------


@query(
    f"""WITH {duck('reads')} SELECT ord, hamming(umi, reverse(umi)) AS distance, floor(-ord / 7.0)::BIGINT AS quotient, (-ord % 7 + 7) % 7 AS rest, (ord % -7 - CASE WHEN ord % 7 > 0 THEN 7 ELSE 0 END) AS negative_rest,
 umi[-1] AS last, umi[2:-2] AS inner, printf('%.2f', ord / 4.0) AS fixed FROM reads"""
)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, u = F.col("ord"), F.col("umi")
    seven = F.lit(7).cast("long")
    return view(spark, sf_dir, "reads").select(
        "ord", B.hamming(u, F.reverse(u)).cast("long").alias("distance"), B.floor_div(-o, seven).alias("quotient"), B.floor_mod(-o, seven).alias("rest"), B.floor_mod(o, -seven).alias("negative_rest"),
        B.item(u, -1).alias("last"), B.piece(u, 1, -1).alias("inner"), B.fixed(o / 4).alias("fixed"),
    )


@query(f"{FQ} SELECT ord, CASE WHEN min(ascii(q)) >= 59 THEN 'phred33,solexa' ELSE 'phred33' END AS encodings FROM (SELECT ord, unnest(string_split(quals, '')) AS q FROM fastq) GROUP BY ord")
def quality_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fastq").select("ord", F.array_join(B.quality_encodings(F.col("quals")), ",").alias("encodings"))


@query(f"{FQ} SELECT ord, length(regexp_extract(seq, '^([ACGT]{{4}})(G+)', 1)) > 0 AS found, 4 + length(regexp_extract(seq, '^([ACGT]{{4}})(G+)', 2)) AS stop FROM fastq WHERE regexp_matches(seq, '^[ACGT]{{4}}G+')")
def pattern_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Z.match(F.col("seq"), "(?P<umi_1>[ACGT]{4})(?P<discard_1>G+)")
    out = view(spark, sf_dir, "fastq").select("ord", found.alias("m")).where("m is not null")
    return out.select("ord", F.lit(True).alias("found"), F.col("m")["discard_1"]["stop"].cast("long").alias("stop"))


@query(f"{AL} SELECT ord, t_nh AS nh, 'x' AS bx, t_rx AS copied FROM alignments")
def tag_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = view(spark, sf_dir, "alignments").withColumn("t2", P.set_tag(F.col("tags"), "BX", F.lit("x")))
    copied = P.copy_tag(P.set_tag(F.col("t2"), "RX", F.lit("old")), F.col("tags"), "RX")
    return reads.select("ord", F.col("t2")["NH"].alias("nh"), F.col("t2")["BX"].alias("bx"), copied["RX"].alias("copied"))


@query(
    f"WITH {duck('reads')} SELECT ord, hamming(umi, reverse(umi))::INT AS distance, floor(-ord / 7.0)::BIGINT AS quotient, substr(umi, 1, 3) AS first_block, substr(umi, 4, 2) AS second_block FROM reads"
)
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions that a session can register for SQL."""
    G.register(spark)
    return view(spark, sf_dir, "reads").selectExpr(
        "ord", "hamming_distance(umi, reverse(umi)) AS distance", "floor_div(-ord, 7) AS quotient", "block_part(umi, 0, 2) AS first_block", "block_part(umi, 1, 2) AS second_block"
    )


@query(f"WITH {duck('reads')} SELECT ord FROM reads WHERE ord < 500")
def first_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.first_reads(view(spark, sf_dir, "reads").select("ord"), 500)


@query(f"WITH {duck('reads')} SELECT ord FROM reads WHERE ord <= (SELECT ord FROM reads WHERE umi LIKE 'A%' ORDER BY ord LIMIT 1 OFFSET 40)")
def first_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads up to the one after 40 matches."""
    reads = view(spark, sf_dir, "reads").select("ord", F.col("umi").startswith("A").alias("matched"))
    return L.subset_matched(reads, "matched", 40, paired=False).select("ord")


@query(f"WITH {duck('reads')} SELECT ord FROM reads WHERE ord <= (SELECT min(ord) FROM reads WHERE umi LIKE 'A%' AND ord >= 40)")
def first_matched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs up to the first match after 40 pairs."""
    reads = view(spark, sf_dir, "reads").select("ord", F.col("umi").startswith("A").alias("matched"))
    return L.subset_matched(reads, "matched", 40, paired=True).select("ord")


@query(
    f"""{FQ}, {UMI_LISTS}, y AS (SELECT substr(seq, 3, 5) AS raw FROM fastq), z AS (SELECT raw, CASE WHEN raw IN (SELECT umi FROM w) THEN raw ELSE barcode END AS umi FROM y LEFT JOIN f ON error = raw)
SELECT umi, count(*) FILTER (raw = umi) AS count_no_errors, count(*) FILTER (raw <> umi) AS count_errors FROM z WHERE umi IS NOT NULL GROUP BY umi"""
)
def umi_correction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([("AAAAA",), ("CCCCC",), ("ACGTA",)], "barcode string")
    raw = raw_reads(spark, sf_dir)
    out = X.extract(raw, X.ExtractOptions("CCNNNNN"), umis=X.Lookup("umi", listed, L.derive_errors(listed, 1))).where("kept").select("ord", "umi")
    return X.correction_log(raw.select("ord", F.substring("read1.seq", 3, 5).alias("raw")).join(out, "ord"))


# --- streams --------------------------------------------------------------------------------------------------------


@query(f"{C} SELECT contig, pos, umi, n FROM c")
def streamed_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of a stream of sorted reads, closed as the position moves on; equal to the batch result."""
    reads = view(spark, sf_dir, "reads").select("ord", "contig", "pos", "umi")
    return T.run_once(reads)

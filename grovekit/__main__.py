"""Command line: python -m grovekit -i GENES [-o OUT] [--search-space S1|S2|S3] [--score-species-tree TREE] ..."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession

from .operators import support, taxa
from .plans import checks, dumps, inference
from .sources import newick

_SPACES = {**{k: k for k in ("S1", "S2", "S3")}, "1": "S1", "2": "S2", "3": "S3", "incomplete-local": "S1", "complete-full": "S2", "exhaustive": "S3"}
#: Flags that choose a device, a thread or batch size, or how much is logged: Spark's configuration does that here.
_NO_EFFECT = ("--auto", "--cpu", "--gpu", "-q", "--quiet", "-vv", "-vvv", "--unrooted", "--no-gpu-batch", "--rooted", "--gpu-strict")
_NO_EFFECT_VALUE = (
    "-t", "-T", "--threads", "--num-threads", "-m", "--seeds", "--large-n-score-type", "--large-score-type", "--stepb-restriction", "--log-file", "--gpu-batch-size", "--gpu-batches", "--gpu-dist-tile-size", "--gpu-progress-interval", "--gpu-sim-vram-cap-mb",
    "--gpu-treewalk-vram-cap-mb", "--gpu-vram-control-factor", "--gpu-vram-occupancy-factor", "--gpu-dp-state-space-construction-output-cap", "--gpu-dp-state-space-progress-max-steps", "--gpu-dp-state-space-progress-time-interval",
)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="grovekit", allow_abbrev=False)
    p.add_argument("-i", "--input")
    p.add_argument("-o", "--output", help="folder for the result; otherwise it is printed")
    p.add_argument("--search-space", default="S1", type=lambda x: _SPACES[x.upper() if x.upper() in _SPACES else x.lower()])
    p.add_argument("--im", "--intersection-method", "--weight-intersection-method", default="I4", help="accepted; all give the same counts")
    p.add_argument("--search-mode", choices=("local", "full"))
    p.add_argument("--keep-polytomy-during-inference", action="store_true")
    p.add_argument("--anchor", "--anchor-outgroup", dest="anchor", action="store_true", default=True)
    p.add_argument("--no-anchor", "--no-anchor-outgroup", dest="anchor", action="store_false")
    p.add_argument("--anchor-taxon", help="by default the first taxon of the input")
    p.add_argument("--autocomplete-incomplete-gene-trees", action="store_true")
    p.add_argument("--completion-method", choices=("similarity", "distance"))
    p.add_argument("--consensus-experimental", action="store_true")
    p.add_argument("--stepb-quadratic-nn-balls", action="store_true")
    p.add_argument("--stepb-random-leftover-resolution", action="store_true")
    p.add_argument("--stepb-process-large-polytomies", action="store_true", help="accepted; large ones are always resolved")
    p.add_argument("--resolve-input-gene-tree-polytomies", action="store_true")
    p.add_argument("--score-species-tree", "-c", "--score", "--species-tree")
    p.add_argument("--branch-support", "--support", action="store_true", help="also annotate the result")
    p.add_argument("--branch-support-only", "--support-only", action="store_true")
    p.add_argument("--support-output", help="folder for the annotated tree; by default the output's name with -support")
    p.add_argument("--support-format", default="pp", choices=support.STYLES)
    p.add_argument("--lambda", "--support-lambda", dest="prior", type=float, default=0.5)
    p.add_argument("--taxa-file", "--species-list", "--species-list-file")
    p.add_argument("--extract-taxa", action="store_true")
    p.add_argument("--taxa-set", "--taxa-operation", choices=("union", "intersection"), default="union")
    p.add_argument("--verify-distance-matrix", action="store_true")
    p.add_argument("--verify-similarity-matrix", action="store_true")
    p.add_argument("--verify-upgma", action="store_true")
    p.add_argument("--verify-greedy-consensus", action="store_true")
    p.add_argument("--dump-clusters", help="folder")
    p.add_argument("--dump-completed-gene-trees", help="folder")
    p.add_argument("--prune-search-space", "--prune-unreachable", dest="prune", action="store_true", default=True)
    p.add_argument("--no-prune-search-space", "--no-prune-unreachable", dest="prune", action="store_false")
    for phase in checks.PHASES:
        p.add_argument(f"--verify-{phase}", action="store_true", help="the phase's numbers and faults, and nothing else")
    p.add_argument("--version", action="version", version="grovekit")
    p.add_argument("--diagnose", action="store_true")
    for flag in _NO_EFFECT:
        p.add_argument(flag, action="store_true", help=argparse.SUPPRESS)
    for flag in _NO_EFFECT_VALUE:
        p.add_argument(flag, help=argparse.SUPPRESS)
    return p


def options(a: argparse.Namespace, names: list[str]) -> inference.Options:
    changes: dict = {"keep_multifurcations": a.keep_polytomy_during_inference, "prune": a.prune}
    if a.search_mode:
        changes["full_search"] = a.search_mode == "full"
    if a.completion_method:
        changes["by_distance"] = a.completion_method == "distance"
    for flag, name in (("autocomplete_incomplete_gene_trees", "completion"), ("consensus_experimental", "consensus"), ("stepb_quadratic_nn_balls", "nearest_balls"), ("stepb_random_leftover_resolution", "random_leftovers"), ("resolve_input_gene_tree_polytomies", "sample_input")):
        if getattr(a, flag):
            changes[name] = True
    if not a.anchor:
        changes["anchor"] = None
    elif a.anchor_taxon is not None:
        if a.anchor_taxon not in names:
            raise ValueError(f"no taxon {a.anchor_taxon}")
        changes["anchor"] = names.index(a.anchor_taxon)
    return inference.preset(a.search_space, **changes)


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("grovekit").getOrCreate()
    if a.diagnose:
        print("\n".join([f"spark {spark.version}", *(f"{k}={v}" for k, v in sorted(spark.sparkContext.getConf().getAll()))]))
        return 0
    if not a.input:
        p.error("-i is needed")
    outputs = [x for x in (a.output, a.support_output, a.dump_clusters, a.dump_completed_gene_trees) if x]
    if len(set(outputs)) < len(outputs) or set(outputs) & {a.input, a.taxa_file, a.score_species_tree}:
        p.error("the output would replace an input or another output")
    if a.branch_support_only and not a.score_species_tree:
        p.error("--branch-support-only needs a species tree")
    genes = newick.read_lines(spark, a.input)
    keep = taxa.read_list(spark.read.text(a.taxa_file))[0] if a.taxa_file else None

    def put(lines: list[str] | DataFrame, folder: str | None) -> None:
        if folder is None:
            print("\n".join(lines if isinstance(lines, list) else (r[0] for r in lines.toLocalIterator())))
        else:
            rows = spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1) if isinstance(lines, list) else lines
            rows.write.text(folder)

    def put_support(species: DataFrame) -> None:
        names, _, masks = inference.universe(genes, None)
        found = support.label(inference.annotated(genes, species, a.prior), a.support_format)
        put([inference.support_newick(species, found, names, masks)], a.support_output or (a.output and f"{os.path.splitext(a.output)[0]}-support"))

    if a.extract_taxa:
        names = taxa.intersection(genes) if a.taxa_set == "intersection" else taxa.union(genes)
        put([r["name"] for r in names.orderBy("name").toLocalIterator()], a.output)
        return 0
    names, listed, masks = inference.universe(genes, keep)
    wanted = (a.verify_distance_matrix, a.verify_similarity_matrix, a.verify_upgma, a.verify_greedy_consensus, a.dump_clusters, a.dump_completed_gene_trees)
    if any(wanted):
        nodes = inference.refined(newick.parse(genes, names, masks, keep), masks).persist()
        if a.dump_clusters:
            put(dumps.cluster_lines(nodes, names, masks, 0 if a.anchor else None), a.dump_clusters)
        if a.dump_completed_gene_trees:
            put(dumps.completed_trees(nodes, names, masks, a.completion_method == "distance").orderBy("tree").select("newick"), a.dump_completed_gene_trees)
        for flag, lines in (
            (a.verify_distance_matrix, lambda: dumps.matrix(nodes, listed, False)), (a.verify_similarity_matrix, lambda: dumps.matrix(nodes, listed, True)),
            (a.verify_upgma, lambda: dumps.guide_bipartitions(nodes, listed, masks)), (a.verify_greedy_consensus, lambda: dumps.consensus_lines(nodes, listed, masks)),
        ):
            if flag:
                put(lines(), a.output)
                return 0
    if a.score_species_tree:
        species = newick.read_lines(spark, a.score_species_tree)
        if not a.branch_support_only:
            put([f"QUARTET_SCORE: {inference.score(genes, species, keep)}"], a.output)
        if a.branch_support or a.branch_support_only:
            put_support(species)
        return 0
    phases = [x for x in checks.PHASES if getattr(a, f"verify_{x}")]
    if phases:
        nodes = inference.refined(newick.parse(genes, names, masks, keep), masks)
        found = {r["phase"]: r for r in checks.phases(nodes, masks, 0 if a.anchor else None).collect()}
        put([f"{x}: rows={found[x]['n']} total={found[x]['total']} faults={found[x]['faults']}" for x in phases], a.output)
        return 0
    # the tree is written before its score, which is computed then and may fail
    out = inference.infer(genes, options(a, listed), keep)
    put([out.newick], a.output)
    print(f"QUARTET_SCORE: {out.score}")
    if a.branch_support:
        put_support(newick.from_lines(spark, [out.newick]))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

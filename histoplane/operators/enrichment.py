"""Over-representation of gene sets in clusters' differential proteins, on a local table of sets."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import benjamini_hochberg, hypergeometric_p
from .cells import require

# Names of the databases asked for by default, by species.
DEFAULT_DATABASES = {
    "human": ["CORUM", "Reactome_2022", "KEGG_2021_Human", "GO_Biological_Process_2021", "GO_Molecular_Function_2021"],
    "mouse": ["Mouse_Gene_Atlas", "Reactome_2022", "KEGG_2021_Mouse", "GO_Biological_Process_2021", "GO_Molecular_Function_2021"],
    "rat": ["Reactome_2022", "KEGG_2021_Rat", "GO_Biological_Process_2021", "GO_Molecular_Function_2021"],
}


def significant_genes(diff: DataFrame, mapping: DataFrame | None = None, p_cutoff: float = 0.05, diff_cutoff: float = 0.0, use_adjusted: bool = True) -> DataFrame:
    """``Cluster, gene``: distinct significant proteins by their gene's name, of clusters with at least two."""
    p = "adj_p_value" if use_adjusted else "p_value"
    require(diff, "Protein", "Cluster", "MeanDiff", p)
    if mapping is not None:
        diff = diff.join(mapping.select(F.col("Original_Name").alias("Protein"), F.col("Gene_Symbol").alias("_g")), "Protein", "left").withColumn("gene", F.coalesce("_g", "Protein"))
    else:
        diff = diff.withColumn("gene", F.col("Protein"))
    found = diff.where((F.abs("MeanDiff") > diff_cutoff) & (F.col(p) < p_cutoff)).select("Cluster", "gene").distinct()
    return found.withColumn("query", F.count("*").over(Window.partitionBy("Cluster"))).where("query >= 2")


def overlaps(genes: DataFrame, sets: DataFrame) -> DataFrame:
    """``Cluster, Database, Term, k, size, query, universe``: shared genes; the universe is a database's genes."""
    universe = sets.groupBy("database").agg(F.count_distinct("gene").alias("universe"))
    sized = sets.withColumn("size", F.count("*").over(Window.partitionBy("database", "term")))
    pairs = genes.join(sized, "gene")
    inside = genes.join(sets.select("database", "gene").distinct(), "gene").groupBy("Cluster", "database").agg(F.count("*").alias("query"))
    k = pairs.groupBy("Cluster", "database", "term", "size").agg(F.count("*").alias("k"))
    return k.join(inside, ["Cluster", "database"]).join(universe, "database").select("Cluster", F.col("database").alias("Database"), F.col("term").alias("Term"), "k", "size", "query", "universe")


def cluster_enrichment(diff: DataFrame, sets: DataFrame, mapping: DataFrame | None = None, species: str = "human", databases: list[str] | None = None, custom_databases: list[str] | None = None, p_cutoff: float = 0.05, diff_cutoff: float = 0.0, use_adjusted: bool = True) -> DataFrame:
    """Terms with FDR below the cut: hypergeometric tails, adjusted within each cluster and database."""
    if databases is None:
        if species not in DEFAULT_DATABASES:
            warnings.warn(f"no databases for {species}: those for human are taken")
        databases = DEFAULT_DATABASES.get(species, DEFAULT_DATABASES["human"])
    wanted = sorted({*databases, *(custom_databases or [])})
    chosen = sets.where(F.col("database").isin(wanted))
    found = overlaps(significant_genes(diff, mapping, p_cutoff, diff_cutoff, use_adjusted), chosen)
    tested = found.withColumn("p_value", hypergeometric_p("k", "size", "query", "universe"))
    adjusted = benjamini_hochberg(tested, "p_value", ["Cluster", "Database"], ["Term"], "FDR").where(F.col("FDR") < p_cutoff)
    return adjusted.withColumn("Overlap", F.concat_ws("/", "k", "size")).withColumn("GenesN", F.col("size"))


def top_terms(enriched: DataFrame, top_n: int = 5, fdr_cutoff: float = 0.05, width: int = 40) -> DataFrame:
    """The first terms of each cluster by FDR, short names and -log10 FDR."""
    require(enriched, "Cluster", "Term", "FDR")
    first = Window.partitionBy("Cluster").orderBy("FDR", "Term")
    short = F.regexp_replace("Term", r" \(.*", "")
    short = F.when(F.length(short) > width, F.concat(F.left(short, F.lit(width - 3)), F.lit("..."))).otherwise(short)
    kept = enriched.where(F.col("FDR") < fdr_cutoff).withColumn("place", F.row_number().over(first)).where(F.col("place") <= top_n)
    return kept.withColumn("label", short).withColumn("log10FDR", F.when(F.col("FDR") > 0, -F.log10("FDR")))

"""Named datasets: a catalog of what is expected, and a loader that reads edges and features, splits, and refuses what does not fit."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave import scratch
from netweave.sources import hyperedges as H

#: Nodes and edges of public datasets by name; 0 where they are not stated.
EXPECTED = {
    "cora": (2388, 970), "dblp": (41302, 20865), "citeseer": (1458, 1004), "pubmed": (3840, 7531), "cora_cocitation": (1434, 1483), "dblp_collaboration": (15639, 18390), "ndc_class": (1149, 1047),
    "email_enron": (143, 1459), "email_eu": (998, 0), "contact_high_school": (327, 7818), "contact_primary_school": (242, 12704), "tags_ask_ubuntu": (0, 0), "tags_math_sx": (0, 0), "tags_stack_overflow": (0, 0),
    "coauth_mag_geology": (0, 0), "coauth_mag_history": (0, 0), "dblp_10k": (31968, 10000), "recipe100k": (100896, 11822), "recipe200k": (240094, 18049),
}


@dataclass(frozen=True)
class Entry:
    """A dataset of the catalog. Paths are below the root that a loader is given; without one the key names the files."""

    key: str
    nodes: int = 0
    edges: int = 0
    protocols: tuple[str, ...] = ("sns", "mns", "cns", "mix")
    edge_path: str | None = None
    feature_path: str | None = None

    def edges_at(self, root: str) -> str:
        return f"{root.rstrip('/')}/{self.edge_path or f'{self.key}_edges.txt'}"

    def features_at(self, root: str) -> str:
        return f"{root.rstrip('/')}/{self.feature_path or f'{self.key}_features.parquet'}"


@dataclass(frozen=True)
class Dataset:
    """Edges (edge_id, nodes, size, split), features (node_id, vec) or None, and the number of nodes."""

    entry: Entry
    edges: DataFrame
    features: DataFrame | None
    num_nodes: int

    def part(self, *splits: str) -> DataFrame:
        return self.edges.filter(F.col("split").isin(*splits)).drop("split")

    def future(self) -> DataFrame:
        """What a model of the training part has not seen."""
        return self.part("val", "test")


class Catalog:
    """Entries by key; ``EXPECTED`` to begin with."""

    def __init__(self) -> None:
        self._entries = {k: Entry(k, *v) for k, v in EXPECTED.items()}

    def add(self, entry: Entry) -> None:
        self._entries[entry.key] = entry

    def __getitem__(self, key: str) -> Entry:
        """KeyError for an unknown one."""
        return self._entries[key]

    def keys(self) -> list[str]:
        return sorted(self._entries)


def weight_mapping(text: str) -> dict[str, float]:
    """Weights of a text such as ``a:1,b:2.5``; blank parts count for nothing, others without a colon raise ValueError."""
    out = {}
    for part in filter(str.strip, text.split(",")):
        name, colon, value = part.partition(":")
        if not colon:
            raise ValueError(f"no weight in {part!r}")
        out[name.strip()] = float(value)
    return out


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, vec) of a Parquet table of those columns, rows over their sum where that is above 0."""
    return H.normalized_features(spark.read.parquet(path).select(F.col("node_id").cast("long"), F.col("vec").cast("array<double>")))


def load(spark: SparkSession, entry: Entry, root: str, seed: int = 1, split: str = "random", features: bool = False, train: float = 0.6, val: float = 0.2, separator: str | None = None) -> Dataset:
    """The dataset of ``entry`` below ``root``. ``split``: random, or cover for a training part that has every node.

    With ``features`` each node has a row of them, whose number is then the number of nodes; else that is the largest id plus one.
    ValueError: numbers of nodes or edges other than the entry's (if stated), edges that break a rule, nodes without features or with several rows of
    them, vectors of different lengths.
    """
    edges = scratch.materialize(H.read_edge_text(spark, entry.edges_at(root), separator), "edges")
    table = scratch.materialize(read_features(spark, entry.features_at(root)), "features") if features else None
    nodes = H.num_nodes(H.incidence_of(edges)) if table is None else table.count()
    count = edges.count()
    for name, stated, found in (("nodes", entry.nodes, nodes), ("edges", entry.edges, count)):
        if stated and stated != found:
            raise ValueError(f"{entry.key} has {found} {name}, not {stated}")
    broken = {k: v for k, v in H.violations(edges, nodes).first().asDict().items() if k != "edges" and v}
    if broken:
        raise ValueError(f"{entry.key} breaks rules: {broken}")
    if table is not None:
        figures = table.agg(F.countDistinct("node_id").alias("ids"), F.min("node_id").alias("low"), F.max("node_id").alias("high"), F.min(F.size("vec")).alias("short"), F.max(F.size("vec")).alias("long")).first()
        if nodes and (figures["ids"], figures["low"], figures["high"]) != (nodes, 0, nodes - 1):
            raise ValueError(f"{entry.key}: the features are not those of nodes 0 to {nodes - 1}, each once")
        if figures["short"] != figures["long"]:
            raise ValueError(f"{entry.key}: feature vectors differ in length")
    makers = {"random": H.random_split, "cover": H.cover_aware_split}
    if split not in makers:
        raise ValueError(f"unknown split {split}")
    return Dataset(entry, scratch.materialize(makers[split](edges, train, val, seed), "split"), table, nodes)


def probe(dataset: Dataset, most: dict[str, int], seed: int = 1) -> Dataset:
    """The dataset with at most ``most[split]`` edges of a split, those of smallest draw; splits that are not named stay whole."""
    from netweave.operators.protocols import sample_sources

    out = None
    for name in ("train", "val", "test"):
        part = dataset.edges.filter(F.col("split") == name)
        part = sample_sources(part, most[name], seed) if name in most else part
        out = part if out is None else out.unionByName(part)
    return replace(dataset, edges=scratch.materialize(out, "probe"))

"""This subpackage's queries by name, with their SQL twins where SQL can express them."""

from __future__ import annotations

from tidewright.llm import clusters, forest, leakage, mojibake, packing, top_items

QUERIES = {
    "p4_found": (clusters.p4_found, clusters.P4_SQL),
    "p4_clusters": (clusters.p4_clusters, None),
    "p4_markov": (clusters.p4_markov, None),
    "p5_found": (top_items.p5_found, top_items.P5_SQL),
    "p6_found": (forest.p6_found, forest.P6_SQL),
    "p6_neighbours": (forest.p6_neighbours, None),
    "p6_classes": (forest.p6_classes, forest.P6_CLASSES_SQL),
    "p7_packed": (packing.p7_packed, None),
    "p7_packed_characters": (packing.p7_packed_characters, packing.P7_CHARACTERS_SQL),
    "p8_found": (leakage.p8_found, leakage.P8_SQL),
    "p8_passages": (leakage.p8_passages, None),
    "p8_clean": (leakage.p8_clean, leakage.P8_CLEAN_SQL),
    "p9_found": (mojibake.p9_found, None),
    "p9_restored": (mojibake.p9_restored, None),
}

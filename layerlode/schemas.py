"""Schemas of the long tables that every operator reads and returns. Noise has the cluster -1."""

from __future__ import annotations

OBJECTS = "object_id bigint, text string, embedding array<double>"
ASSIGNMENTS = "object_id bigint, layer int, cluster int"
CENTROIDS = "layer int, cluster int, centroid array<double>, size bigint"
TREE_EDGES = "parent_layer int, parent_cluster int, child_layer int, child_cluster int"
VOCABULARY = "term_id int, term string, occurrences bigint"
TERM_COUNTS = "object_id bigint, term_id int, n bigint"
TERM_VECTORS = "term_id int, vector array<double>"
EXEMPLARS = "layer int, cluster int, rank int, object_id bigint"
KEYPHRASES = "layer int, cluster int, rank int, term string, score double"
SUBTOPICS = "layer int, cluster int, rank int, sub_layer int, sub_cluster int"
TOPICS = "layer int, cluster int, name string"

NOISE = -1
UNLABELLED = "Unlabelled"
NO_KEYPHRASES = "No notable keyphrases"

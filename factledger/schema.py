"""Table schemas, vocabulary and limits of the ledger (fixed values of its data model)."""

from __future__ import annotations

NAMESPACE = "kg"
MODEL_VERSION = 9
KINDS = ("class", "property", "element", "literal", "episode", "relationship")

NODES = (
    "iri string, kind string, name string, labels array<string>, value string, datatype string, layers array<string>, weight bigint, "
    "stub boolean, search_text string, merge_name string, created_at timestamp_ntz"
)
FACTS = (
    "iri string, type string, property_iri string, s_iri string, o_iri string, layers array<string>, weight bigint, valid_from timestamp_ntz, valid_to timestamp_ntz, "
    "eff_qualified boolean, eff_from timestamp_ntz, eff_to timestamp_ntz, episode_id string, fact_text string, spike string, reason string"
)
#: Audit columns, set after a fact was made.
FACT_AUDIT = "withdrawn_by string, merged_into string, merge_episode_id string, provenance_episode_ids array<string>, layer_episode_id string, judgment_episode_id string"
EPISODES = (
    "iri string, tool string, at timestamp_ntz, note string, previous_fact_iri string, replacement_fact_iri string, supersedes_iri string, "
    "selected_scope array<string>, batch_size int, target_iris array<string>, target_kinds array<string>, modes array<string>"
)
ACTIVATIONS = "id string, result_refs array<string>, embedding array<double>, expires_at_ms bigint"

#: Relationship vocabulary.
SCHEMA = ("INSTANCE_OF", "SUBCLASS_OF", "SUBPROPERTY_OF", "DOMAIN", "RANGE")
SYSTEM = ("CONTRADICTS", "SUPERSEDES")
STRUCTURAL = (*SCHEMA, "ABOUT", "EVIDENCE_FOR", "DERIVED_FROM", "SUPPORTS", *SYSTEM)
FIXED = ("ASSERTS", *STRUCTURAL)
SEARCHABLE = tuple(x for x in FIXED if x not in SYSTEM)
WALKABLE = tuple(x for x in FIXED if x != "ABOUT")
SEED_CLASSES = ("Class", "Property", "Element")
SEED_PROPERTIES = STRUCTURAL
FORBIDDEN_MERGE_LABELS = ("Literal", "Episode", "SemanticActivation", "FactLock", "Meta")
SPIKES = ("Signal", "Pattern", "Insight", "Knowledge")

#: Limits and weights.
DEFAULT_LIMIT, MAX_LIMIT, MAX_BATCH = 20, 100, 20
MAX_DEPTH, HUB_DEGREE = 3, 16
KEYWORDS, KEYWORD_CHARS, KEYWORD_BYTES, PHRASE_BYTES = 16, 4, 64, 512
EXACT_WEIGHT, KEYWORD_WEIGHT = 2.0, 1.0
SEMANTIC_TEXT_BYTES, BUNDLE_REFS, ANCHORS, PER_ENDPOINT, STRUCTURAL_SCALE = 32 * 1024, 3, 16, 16, 0.25
TTL_DAYS, NEIGHBORS, RECALL_FLOOR, CONVERGE_FLOOR, CONVERGE_OVERLAP = 30, 10, 0.65, 0.90, 0.60
RRF_K, DIRECT_WEIGHT, FALLBACK_WEIGHT = 15.0, 2.0, 0.5
MERGE_FLOOR, PROPERTY_MERGE_FLOOR, SUGGESTIONS = 0.85, 0.92, 3
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1
BM25_K1, BM25_B = 1.2, 0.75

"""All queries of the library, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gneiss.plans import concepts, discourse, extraction, intake, relations, reprocess, retrieval, sinks, state, text, trees

NAMES = {
    text: "sentence_split chunk_packing parent_chunks conversation_sections turn_context document_frequency extractive_summary child_summaries lexical_top hash_embedding content_ids html_text",
    retrieval: "fast_lanes cached_evidence fused_documents fused_sections fast_evidence hybrid_evidence legacy_documents legacy_children section_addresses document_addresses concept_terms reach_evidence",
    state: "dense_lane section_children diverse_hits entity_degree one_hop eligible_facts competing_facts admission_classes "
    "projection_states missing_projections census heartbeats order_state outbox_stream windowed_stream quality_metrics",
    relations: "line_entities surface_candidates fact_provenance authorized_facts retired_residue graph_seeds graph_facts canonical_registry registry_decisions corpus_entities grounded_turns "
    "event_funnel run_gaps run_artifacts fact_changes source_plan lane_metrics common_tokens order_predicates excerpts plain_sources document_forms document_regions",
    concepts: "document_concepts section_concepts corpus_concepts enriched_documents phrase_contractions",
    discourse: "document_antecedents conversation_antecedents",
    trees: "page_elements",
    reprocess: "reprocessed_facts reprocessed_counts",
    intake: "manifest_actions manifest_report run_census",
    sinks: "order_upserts registry_versions event_commits projection_claims",
    extraction: "trigger_spans bound_candidates compiled_facts pack_problems",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.lexical_top(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(module, name) for module, names in NAMES.items() for name in names.split()}


def oracle_sql() -> dict[str, str]:
    """A query's SQL is the constant of its name in capitals."""
    return {name: getattr(module, name.upper()) for module, names in NAMES.items() for name in names.split() if hasattr(module, name.upper())}

"""Personal-data scanning, remediation and data-quality checks as Spark DataFrame operators."""

from fieldwarden.functions.patterns import DEFAULT_REGISTRY, PatternRegistry
from fieldwarden.functions.tokens import token
from fieldwarden.operators.anomaly import detect_anomalies
from fieldwarden.operators.autogen import auto_expectations
from fieldwarden.operators.entities import entity_scan, entity_udf
from fieldwarden.operators.expectations import Expectation, validate, validate_findings
from fieldwarden.operators.privacy import (
    format_anomalies,
    k_anonymity,
    minimal_quasi_identifiers,
    quasi_identifiers,
    regulatory_flags,
    semantic_pii,
)
from fieldwarden.operators.profile import dataset_profile, profile
from fieldwarden.operators.profile_state import merged_state, profile_of, profile_state
from fieldwarden.operators.quality import completeness, consistency, plausibility
from fieldwarden.operators.remediate import anonymise, redact_text, remediate
from fieldwarden.operators.remediate_files import remediate_files
from fieldwarden.operators.scan import scan, scan_files
from fieldwarden.plans.analyze import analyze
from fieldwarden.sources.catalog import scan_path
from fieldwarden.sources.sinks import write_files
from fieldwarden.streaming import remediate_stream

__all__ = [
    "DEFAULT_REGISTRY", "PatternRegistry", "Expectation", "analyze", "anonymise", "auto_expectations",
    "completeness", "consistency", "dataset_profile", "detect_anomalies", "entity_scan", "entity_udf",
    "format_anomalies", "k_anonymity", "merged_state", "minimal_quasi_identifiers", "plausibility", "profile", "profile_of",
    "profile_state", "quasi_identifiers", "redact_text", "regulatory_flags", "remediate", "remediate_files",
    "remediate_stream", "scan", "scan_files", "scan_path", "semantic_pii", "token", "validate", "validate_findings",
    "write_files",
]

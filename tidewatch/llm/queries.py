"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidewatch.llm.p1_language import p1_documents, p1_found, p1_segments
from tidewatch.llm.p2_split_overlap import p2_found, p2_report
from tidewatch.llm.p3_history import p3_found
from tidewatch.llm.p4_grouped_splits import p4_found, p4_splits
from tidewatch.llm.p5_near_duplicates import p5_classes, p5_found
from tidewatch.llm.p6_personal import p6_found, p6_redacted
from tidewatch.llm.p7_encode import p7_ids
from tidewatch.llm.p8_packing import p8_pack, p8_report
from tidewatch.llm.p9_severity import p9_found, p9_rates, p9_scores
from tidewatch.llm.sql import ORACLE

QUERIES = {
    "p1_found": p1_found,
    "p1_documents": p1_documents,
    "p1_segments": p1_segments,
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_splits": p4_splits,
    "p5_found": p5_found,
    "p5_classes": p5_classes,
    "p6_found": p6_found,
    "p6_redacted": p6_redacted,
    "p7_ids": p7_ids,
    "p8_pack": p8_pack,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
    "p9_rates": p9_rates,
}

__all__ = ["ORACLE", "QUERIES"]

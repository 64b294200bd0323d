"""Content fingerprints: sixteen hexadecimal digits of SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\x00"


def _short(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def claim_id(source_id, evidence, subject, predicate, object_, polarity, mode, attribution) -> Column:
    """Id of a claim's meaning and quote; offsets and wording of the verb don't count. A null object has its own mark."""
    parts = (source_id, evidence, subject, predicate, F.coalesce(object_, F.lit("\x00NULL\x00")), polarity, mode, attribution)
    return _short(F.concat_ws(NUL, *parts))


def entity_id(mentions: Column) -> Column:
    """Id of a set of mentions, whatever their order."""
    return _short(F.array_join(F.array_sort(F.array_distinct(mentions)), NUL))


def _tagged(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("\x02")).otherwise(F.concat(F.lit("\x03"), value))


def _proposition(p: Column) -> Column:
    inner = F.concat_ws("\x01", p["subject"], p["predicate"], _tagged(p["object"]), p["polarity"], p["mode"], p["attribution"])
    return F.when(p.isNull(), F.lit("\x02")).otherwise(F.concat(F.lit("\x03"), inner))


def annotation_id(entry: Column) -> Column:
    """Id of a derived entry (a struct): what all kinds have, then the fields that its kind uses."""
    used = {
        "condition": (_tagged(entry["condition_text"]), _tagged(entry["scope"]), _proposition(entry["attaches_to"])),
        "resolved_reference": (_tagged(entry["mention"]), _tagged(entry["referent"])),
        "occurrence": (_tagged(entry["base_concept"]), _tagged(entry["scope"])),
        "requirement": (_proposition(entry["reframed_proposition"]), _tagged(entry["reframed_mode"])),
        "description": (_tagged(entry["description_text"]), _tagged(entry["describes"])),
    }
    content = None
    for kind, parts in used.items():
        joined = F.concat_ws(NUL, *parts)
        content = F.when(entry["kind"] == kind, joined) if content is None else content.when(entry["kind"] == kind, joined)
    return _short(F.concat_ws(NUL, entry["source_id"], entry["kind"], entry["evidence"], entry["support"], entry["resolution"], content))

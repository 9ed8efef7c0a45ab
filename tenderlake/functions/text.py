"""Text Column builders: byte-wise truncation, notice URL, role prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results must reproduce.
NOTICE_BASE_URL = "https://oeffentlichevergabe.de/ui/de/search/details?noticeId="
ELLIPSIS = "…"
QUERY_PREFIX = "query: "
PASSAGE_PREFIX = "passage: "
NO_EMBEDDING_MESSAGE = ("No embedding found for this profile. The embedder may not have been "
                        "available when the profile was created.")
NOT_FOUND_MESSAGE = "No company profile found with ID: "


def _is_continuation(b: Column, pos0: int) -> Column:
    """Is byte ``pos0`` (0-based) of binary ``b`` a UTF-8 continuation byte (10xxxxxx)?"""
    byte = F.conv(F.hex(F.substring(b, pos0 + 1, 1)), 16, 10).cast("int")
    return (byte >= 128) & (byte < 192)


def truncate_utf8(col: Column | str, max_bytes: int = 200) -> Column:
    """Keep text of at most ``max_bytes`` UTF-8 bytes; otherwise cut at the last
    character boundary at or below ``max_bytes`` and append an ellipsis.

    A UTF-8 character is at most 4 bytes, so the boundary is one of the four
    positions ``max_bytes .. max_bytes-3``; everything stays in codegen.
    """
    text = F.col(col) if isinstance(col, str) else col
    b = F.encode(text, "UTF-8")
    cut = F.lit(max_bytes - 3)
    for back in (2, 1, 0):
        pos = max_bytes - back
        cut = F.when(~_is_continuation(b, pos), F.lit(pos)).otherwise(cut)
    # the loop leaves the largest non-continuation position (checked last wins)
    truncated = F.concat(F.decode(F.substring(b, 1, cut), "UTF-8"), F.lit(ELLIPSIS))
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(truncated)


def notice_url(release_id: Column | str) -> Column:
    """Link to the public notice; NULL when the release id is NULL."""
    rid = F.col(release_id) if isinstance(release_id, str) else release_id
    return F.concat(F.lit(NOTICE_BASE_URL), rid)


def with_role_prefix(text: Column | str, role: str = "query") -> Column:
    """Prefix a text with the embedding model's role marker."""
    t = F.col(text) if isinstance(text, str) else text
    if role not in ("query", "passage"):
        raise ValueError("role must be 'query' or 'passage'")
    return F.concat(F.lit(QUERY_PREFIX if role == "query" else PASSAGE_PREFIX), t)

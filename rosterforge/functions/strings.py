"""String normalisation as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a label drops or turns into an underscore.
LABEL_DROPPED = "'.:()[]"
LABEL_JOINED = "/\\- "
# Fixed value: the artefact a chat export leaves behind a citation.
CITATION_ARTEFACT = r":contentReference\[[^\]]+\]\{[^}]+\}"

# Fixed value: what counts as whitespace, beside the Unicode property.
SPACE = "[\\s\\x1c-\\x1f]"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def iso_date(value: Column | str) -> Column:
    """First ten characters of an ISO timestamp; empty when absent."""
    return F.substring(F.coalesce(_col(value).cast("string"), F.lit("")), 1, 10)


def normalize_key(value: Column | str, ascii: bool = False) -> Column:
    """Lower case, letters and digits only."""
    lowered = F.lower(F.coalesce(_col(value).cast("string"), F.lit("")))
    pattern = "[^a-z0-9]" if ascii else "[^\\p{L}\\p{N}]"
    return F.regexp_replace(lowered, pattern, "")


def strip_ws(value: Column | str) -> Column:
    """Strip every kind of whitespace, not only spaces."""
    return F.regexp_replace(_col(value), f"(?U)^{SPACE}+|{SPACE}+$", "")


def slug_label(value: Column | str, empty: str | None = None, drop_only_quote: bool = False) -> Column:
    """Folder label. ``drop_only_quote`` is the plain-slug variant; ``empty`` its default."""
    text = F.lower(strip_ws(F.coalesce(_col(value).cast("string"), F.lit(""))))
    if drop_only_quote:
        text = F.translate(text, "'", "")
    else:
        text = F.translate(text, LABEL_JOINED + LABEL_DROPPED, "_" * len(LABEL_JOINED))
    text = F.regexp_replace(text, "[^a-z0-9]+" if drop_only_quote else "[^a-z0-9_]+", "_")
    text = F.regexp_replace(F.regexp_replace(text, "_+", "_"), "^_|_$", "")
    return F.when(text == "", F.lit(empty)).otherwise(text) if empty is not None else text


def api_name(value: Column | str) -> Column:
    """Trimmed, lower-cased, underscores as dashes."""
    return F.translate(F.lower(strip_ws(F.coalesce(_col(value), F.lit("")))), "_", "-")


def clean_text(value: Column | str) -> Column:
    """Unify line ends, drop citation artefacts, squeeze blanks and blank lines, strip."""
    text = F.regexp_replace(_col(value), "\\r\\n?", "\n")
    text = F.regexp_replace(text, CITATION_ARTEFACT, "")
    text = F.regexp_replace(text, "[ \\t]+", " ")
    text = F.regexp_replace(text, "\\n{3,}", "\n\n")
    return strip_ws(text)


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(_col(value), F.lit(""))



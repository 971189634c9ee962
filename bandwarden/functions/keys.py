"""Identity keys and class names."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def source_event_key(unit_key: Column, freq_id: Column) -> Column:
    """Unit key without its own frequency token, namespace kept."""
    pattern = F.concat(F.lit("_"), freq_id.cast("string"), F.lit("(?=\\.[^/]+$)"))
    return F.regexp_replace(F.replace(unit_key, F.lit("\\"), F.lit("/")), pattern, F.lit(""))


def service_class(raw: Column) -> Column:
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return (F.when(key.isin(*C.PRIMARY_CLASSES), "primary")
            .when(key.isin(*C.NON_PRIMARY_CLASSES), "non_primary").otherwise("other"))


def version_geometry(version: Column) -> Column:
    """Detector version without its build tokens (package release, source hash)."""
    cut = F.regexp_replace(version, r"(^|\s)(source=\S+|[A-Za-z_-]+/[0-9][^\s]*)", " ")
    return F.trim(F.regexp_replace(cut, r"\s+", " "))

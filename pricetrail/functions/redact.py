"""Masking of secrets in log text and attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of secrets.
SECRET_KEYS = (
    r"(?i)(password|passwd|secret|token|authorization|cookie|api[_-]?key|service[_-]?role|private[_-]?key|refresh[_-]?token"
    r"|access[_-]?token|database_url|proxy|credential|connection.?string)"
)
MASK = "***"


def text(value: Column) -> Column:
    """Bearer tokens and passwords in links masked."""
    bearer = F.regexp_replace(value, r"(?i)(Bearer\s+)(\S+)", "$1" + MASK)
    return F.regexp_replace(bearer, r"://([^:/@]+):([^@/]+)@", "://$1:" + MASK + "@")


def mapping(values: Column) -> Column:
    """Values under secret keys masked whole, the others as text."""
    return F.transform_values(values, lambda k, v: F.when(k.rlike(SECRET_KEYS), MASK).otherwise(text(v)))


def error_message(message: Column) -> Column:
    """One line; a message that names a secret is withheld."""
    line = F.trim(F.regexp_replace(message, r"\s+", " "))
    withheld = "Erro sanitizado (detalhe omitido por segurança)."
    return F.when(line == "", F.lit(None).cast("string")).when(line.rlike(SECRET_KEYS), withheld).otherwise(line)

"""Column expressions over names: object URLs, paths, engine codes and keyed hashes."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Layout of an object URL that carries its credentials.
URL_PATTERN = r"^s3://([^:]*):([^@]*)@([^/]*)/([^/]*)/(.*)"
URL_PARTS = ("access", "secret", "endpoint", "bucket", "key")

# Codes stored for text detectors and for entity detectors.
OCR_ENGINES = {"tesseract": 1, "easyocr": 2, "keras": 3, "ultrasoundregions": 4, "scannedform": 5}
NER_ENGINES = {"spacy": 10, "flair": 20, "stanford": 30, "stanza": 40, "allowlist": 50, "scannedform": 60}
NER_NAMES = {10: "spacy", 11: "spacy", 12: "spacy", 13: "spacy", 20: "flair", 30: "stanford",
             40: "stanza", 50: "allowlist", 60: "scannedform"}


def url_parse(url: Column) -> Column:
    """Struct of access, secret, endpoint, bucket and key; null when the URL has another form."""
    parts = F.struct(*(F.regexp_extract(url, URL_PATTERN, i + 1).alias(n) for i, n in enumerate(URL_PARTS)))
    return F.when(url.rlike(URL_PATTERN), parts)


def url_build(access: Column | None, secret: Column | None, endpoint: Column, bucket: Column, key: Column) -> Column:
    """Object URL; without both credentials the endpoint is left out as well."""
    host = F.regexp_replace(endpoint, r"https://|http://|/", "")
    plain = F.concat(F.lit("s3://"), bucket, F.lit("/"), key)
    if access is None or secret is None:
        return plain
    signed = F.concat(F.lit("s3://"), access, F.lit(":"), secret, F.lit("@"), host, F.lit("/"), bucket,
                      F.lit("/"), key)
    without = (F.coalesce(access, F.lit("")) == "") | (F.coalesce(secret, F.lit("")) == "")
    return F.when(without, plain).otherwise(signed)


def url_sanitise(url: Column) -> Column:
    """The URL without credentials; apply before a URL is stored anywhere."""
    return F.when(url.rlike(URL_PATTERN), F.regexp_replace(url, URL_PATTERN, "s3://$4/$5"))


def url_compare(a: Column, b: Column) -> Column:
    """Equal apart from the credentials."""
    return url_sanitise(a).eqNullSafe(url_sanitise(b))


def output_path(path: Column, target: str | None = None, relative: str | None = None,
                suffix: str | None = ".redacted.dcm", target_is_file: bool = False) -> Column:
    """Name of the redacted copy.

    Without ``target`` the copy lies beside the input; a target folder receives the base
    name, or the rest of the path below ``relative``; a target file is used as it is.
    """
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    renamed = F.concat(F.replace(base, F.lit(".dcm"), F.lit("")), F.lit(suffix)) if suffix else base
    if target and target_is_file:
        return F.lit(target)
    if target and relative:
        below = F.substring(path, F.lit(len(relative.rstrip("/")) + 2), F.length(path))
        inside = path.startswith(relative.rstrip("/") + "/")
        rest = F.when(inside, below).otherwise(
            F.raise_error(F.concat(F.lit("path lies outside the relative root: "), path)))
        return F.concat(F.lit(target.rstrip("/") + "/"), rest)
    if target:
        return F.concat(F.lit(target.rstrip("/") + "/"), renamed)
    absolute_root = path.rlike(r"^/[^/]*$")
    return (F.when(absolute_root, F.concat(F.lit("/"), renamed)).when(folder == "", renamed)
            .otherwise(F.concat(folder, F.lit("/"), renamed)))


def _lookup(key: Column, mapping: dict, default) -> Column:
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def ocr_enum(name: Column) -> Column:
    return _lookup(name, OCR_ENGINES, -1)


def ocr_enum_name(code: Column) -> Column:
    return _lookup(code, {v: k for k, v in OCR_ENGINES.items()}, None)


def ner_enum(name: Column) -> Column:
    """Code of an engine name; a name shared by several models gives the first of them."""
    return _lookup(name, NER_ENGINES, -1)


def ner_enum_name(code: Column) -> Column:
    return _lookup(code, NER_NAMES, None)


def decimal_digits(hexadecimal: Column) -> Column:
    """Decimal digits of the first 30 hexadecimal digits: 120 bits, the most that a decimal of 38 digits holds."""
    def half(start: int) -> Column:
        return F.conv(F.substring(hexadecimal, start, 15), 16, 10).cast("decimal(19,0)")

    return (half(1) * F.lit(1 << 60).cast("decimal(19,0)") + half(16)).cast("decimal(38,0)").cast("string")


def pseudonymise_uid(uid: Column, salt: str, mode: str = "decimal") -> Column:
    """Replace an identifier by a keyed hash; equal identifiers get equal ones, null stays null.

    ``decimal`` gives the decimal digits of the first 120 bits of a salted SHA-256, which fits the digits-and-dots
    identifier syntax; ``sha2`` gives all 64 hexadecimal digits. Both are column expressions and take a salt of any length.
    ``blake2s`` gives the digits of a 128-bit keyed hash by Arrow batches, for archives treated that way before; its salt has
    at most 8 bytes.
    """
    if not salt:
        raise ValueError("an empty salt lets anyone repeat the hashes")
    key = salt.encode()
    if mode in ("sha2", "decimal"):
        hashed = F.sha2(F.concat(F.lit(salt), uid), 256)
        return hashed if mode == "sha2" else decimal_digits(hashed)
    if mode != "blake2s":
        raise ValueError(f"unknown mode {mode}")
    if len(key) > hashlib.blake2s.SALT_SIZE:
        raise ValueError(f"a salt of this mode has at most {hashlib.blake2s.SALT_SIZE} bytes")

    @F.pandas_udf(T.StringType())
    def decimal_hash(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else str(int.from_bytes(
            hashlib.blake2s(v.encode(), digest_size=16, salt=key).digest(), "big")))

    return decimal_hash(uid)

"""Column functions. All are built-in expressions, so they stay inside code generation."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digest families in the order in which a spelling is matched.
DIGESTS = ("sha512", "sha384", "sha256", "sha224", "sha3-512", "sha3-256", "sha1", "md5", "md4", "md2", "ripemd160")
SEPARATOR, NULL_FIELD = "\x1f", "\\N"


def document_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def hmac_sha256(message: Column, key: str) -> Column:
    """Hex HMAC by two nested digests over padded keys, which are literals of the plan (so don't log plans). Keys under 16 characters are refused."""
    if len(key) < 16:
        raise ValueError("a key has at least 16 characters")
    raw = key.encode()
    if len(raw) > 64:
        import hashlib

        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def canonical(*fields: Column) -> Column:
    """The bytes a ledger record's MAC covers: fields in fixed order, nulls as \\N, parted by U+001F."""
    return F.concat_ws(SEPARATOR, *[F.coalesce(f.cast("string"), F.lit(NULL_FIELD)) for f in fields])


def asn1_time(text: Column) -> Column:
    """UTCTime (YYMMDDHHMMSSZ, years below 50 are 20xx) and GeneralizedTime (YYYYMMDDHHMMSSZ); else null."""
    full = F.when(F.length(text) == 13, F.concat(F.when(F.substring(text, 1, 2) < "50", "20").otherwise("19"), text)).otherwise(text)
    return F.when(full.rlike(r"^\d{14}Z$"), F.try_to_timestamp(F.substring(full, 1, 14), F.lit("yyyyMMddHHmmss")))


def normalise_serial(serial: Column) -> Column:
    """Hex without leading zeros, one digit at least."""
    return F.regexp_replace(F.lower(serial), "^0+(?=.)", "")


def normalise_digest(name: Column) -> Column:
    """The first family whose name occurs in the spelling."""
    out = F.lit(None).cast("string")
    for d in reversed(DIGESTS):
        out = F.when(F.contains(F.lower(name), F.lit(d)), d).otherwise(out)
    return out


def extract_cn(dn: Column) -> Column:
    found = F.regexp_extract(dn, r"CN=([^\n,]+)", 1)
    return F.when(found != "", F.trim(found)).otherwise(dn)


def uri_host(uri: Column) -> Column:
    """Host in lower case without credentials, port and trailing dot; null where there is no scheme with `//`."""
    rest = F.when(F.substring_index(uri, "://", 1).rlike("^[A-Za-z][A-Za-z0-9+.-]*$") & uri.contains("://"), F.substring(uri, F.instr(uri, "://") + 3, F.lit(1 << 30)))
    authority = F.element_at(F.split(rest, "[/?#]", 2), 1)
    return F.rtrim(F.lower(F.substring_index(F.substring_index(authority, "@", -1), ":", 1)), F.lit("."))


def normalise_family(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(name), r"\s+", " "))


def turkish_upper(text: Column) -> Column:
    return F.upper(F.translate(text, "iı", "İI"))


def turkish_lower(text: Column) -> Column:
    return F.lower(F.translate(text, "Iİ", "ıi"))


def turkish_capitalize(text: Column) -> Column:
    """The first character of each word in upper case, the rest as it is."""
    words = F.regexp_extract_all(text, F.lit(r"\s+|\S+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(turkish_upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def stable_json_digest(json: Column) -> Column:
    """Of a JSON value of any depth, whatever the order of its keys; references ({"$ref": ...}) are alike whatever they point to. Null for what is no JSON."""
    ordered = F.to_json(F.try_parse_json(json))  # a variant holds the keys of its objects in order
    return F.sha2(F.regexp_replace(ordered, r'\{"\$ref":"(?:[^"\\]|\\.)*"\}', '"ref"'), 256)


def stable_digest(entries: Column) -> Column:
    """Of a map, whatever the order of its keys: a null value differs from an absent key."""
    pairs = F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit(NULL_FIELD))))
    return F.sha2(F.array_join(pairs, SEPARATOR), 256)


def client_key(token: Column, address: Column) -> Column:
    return F.coalesce(F.concat(F.lit("t:"), F.substring(F.sha2(token, 256), 1, 16)), F.concat(F.lit("ip:"), address))

"""Column functions on asset text. Everything here stays inside Spark expressions."""

from pyspark.sql import Column, functions as F

from stacklore import constants as K

# White space that does not count at the ends of a text, Unicode spaces included.
SPACE = "".join(map(chr, [
    *range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287,
    12288]))


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Drop leading and trailing white space; looks at the ends of the text only."""
    return F.trim(col(c), F.lit(SPACE))


def code_hash(code) -> Column:
    """Content hash: white space at the ends and CRLF line ends do not count."""
    return F.sha2(F.replace(strip(code), F.lit("\r\n"), F.lit("\n")), 256)


def project_or_default(project) -> Column:
    return F.coalesce(F.nullif(col(project), F.lit("")), F.lit(K.DEFAULT_PROJECT))


def search_document(name, description, tags, code) -> Column:
    """The text that stands for an asset when it is embedded."""
    return F.concat(
        F.lit("LOGIC ASSET: "), col(name),
        F.lit("\nTECHNICAL SPECIFICATION:\n"), col(description),
        F.lit("\nTAGS: "), F.array_join(col(tags), ", "),
        F.lit("\n--- IMPLEMENTATION DETAILS ---\n"), col(code),
    )


def snippet(code, chars=K.SNIPPET_CHARS) -> Column:
    code = col(code)
    cut = F.concat(F.left(code, F.lit(chars)), F.lit("..."))
    return F.when(F.length(code) > chars, cut).otherwise(code)


def extension(language) -> Column:
    pairs = [F.lit(x) for item in K.EXTENSIONS.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[F.lower(col(language))], F.lit("txt"))


def infer_path(content) -> Column:
    """Path named by a leading comment such as ``# filename: a/b.py``."""
    found = F.regexp_extract(
        col(content), r"(?md)^#\s*(?:filename|file|path):\s*([a-zA-Z0-9_./-]+)", 1
    )
    return F.nullif(found, F.lit(""))


def clean_category(category) -> Column:
    printable = F.regexp_replace(
        col(category), r"[\p{C}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]", ""
    )
    kept = F.left(F.trim(printable), F.lit(50))
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("News"))


def is_draft(description) -> Column:
    return F.coalesce(F.upper(col(description)).contains("DRAFT"), F.lit(False))


def needs_enrichment(description, tags) -> Column:
    short = F.length(F.coalesce(col(description), F.lit(""))) < K.DESCRIPTION_MIN_LENGTH
    return short | (F.size(F.coalesce(col(tags), F.array().cast("array<string>"))) == 0)


def description_status(description) -> Column:
    text = F.coalesce(col(description), F.lit(""))
    return F.when(text == "", F.lit("EMPTY")).otherwise(
        F.concat(F.lit("EXISTS (length: "), F.length(text).cast("string"), F.lit(")"))
    )


def wants_generation(query) -> Column:
    return F.lower(col(query)).rlike("|".join(K.GENERATION_WORDS))


def review_flag(reference, comment) -> Column:
    return (col(reference) != "N/A") | F.lower(col(comment)).rlike("|".join(K.REVIEW_WORDS))


def valid_email(address) -> Column:
    return col(address).rlike(r"^[^@]+@[^@]+\.[^@]+")


def verified_description(description) -> Column:
    """Swap the draft marker for the verified one, adding it where neither is present."""
    swapped = F.replace(col(description), F.lit(K.DRAFT_MARK), F.lit(K.VERIFIED_MARK))
    return F.when(swapped.contains(K.VERIFIED_MARK), swapped).otherwise(
        F.concat(F.lit(K.VERIFIED_MARK + " "), swapped)
    )


def failed_description(description, reason) -> Column:
    note = F.concat(F.lit("\n(Validation Failed: "), col(reason), F.lit(")"))
    return F.when(F.contains(col(description), note), col(description)).otherwise(
        F.concat(col(description), note)
    )


def env_drift(stored, current: dict) -> Column:
    """Differences between a stored fingerprint column and the present environment."""
    stored = col(stored)

    def shown(c):
        return F.coalesce(c, F.lit("None"))

    def differs(field, label):
        now = F.lit(current.get(field))
        return F.when(
            ~stored[field].eqNullSafe(now),
            F.concat(F.lit(f"{label}: Stored="), shown(stored[field]),
                     F.lit(", Current="), shown(now)),
        )

    def minor(c):
        return F.substring_index(F.coalesce(c, F.lit("0.0.0")), ".", 2)

    python_now = F.lit(current.get("python_version"))
    python = F.when(
        minor(stored["python_version"]) != minor(python_now),
        F.concat(F.lit("Python Version Drift: Stored="), shown(stored["python_version"]),
                 F.lit(", Current="), shown(python_now)),
    )
    return F.array_compact(F.array(
        differs("os", "OS mismatch"),
        python,
        differs("cpu_arch", "Architecture Drift"),
        differs("execution_driver", "Execution Driver Change"),
    ))


def hash_embedding_value(text) -> Column:
    """MD5 of the text, as a number modulo 1000, over 1000: a stand-in vector value."""
    digest = F.md5(col(text))

    def mod1000(hex16):
        return F.conv(hex16, 16, 10).cast("decimal(20,0)") % 1000

    high = mod1000(F.substring(digest, 1, 16))
    low = mod1000(F.substring(digest, 17, 16))
    # 2^64 mod 1000 = 616
    return (((high * 616 + low) % 1000).cast("double")) / 1000.0

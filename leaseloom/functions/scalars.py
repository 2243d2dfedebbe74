"""Scalar semantics as Columns: coercers, derivations, figure normalisation, formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaseloom import schemas as S

NUMBER = T.DecimalType(30, 14)
_SPACE = " \t\n\r\x0b\x0c "


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACE))


def as_text(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


_PAIRED = r"^\(([^()]*)\)$"


def _number(c: Column, kind: str) -> Column:
    """Cell text without separators as a number: blank is 0, one pair of parentheses around a number negates it, junk is null."""
    bare = strip(F.translate(F.coalesce(c, F.lit("")), ",$%", ""))
    paired = bare.rlike(_PAIRED)
    figure = strip(F.when(paired, F.regexp_extract(bare, _PAIRED, 1)).otherwise(bare))
    if kind == "int":
        figure = F.regexp_replace(figure, r"\.0*$", "")
    number = F.when(figure == "", F.lit(0).cast(kind)).otherwise(figure.try_cast(kind))
    return F.when(paired, -number).otherwise(number).cast(kind)


def as_decimal(c: Column) -> Column:
    """Money or percent text to a decimal; blank is 0, junk is null (see `as_decimal_error`)."""
    # a bare figure needs no cleaning, which is what most cells hold
    return F.when(c.isNull(), F.lit(0).cast(NUMBER)).otherwise(
        F.coalesce(c.try_cast(NUMBER), _number(c, NUMBER)))


def as_decimal_error(c: Column) -> Column:
    return as_decimal(c).isNull()


def as_date(c: Column) -> Column:
    """`MM/dd/yyyy`, then `yyyy-MM-dd`, then `MM/dd/yy` (69-99 belong to the 1900s)."""
    iso = strip(c)
    for shape, form in (
        (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2"),
        (r"^(\d{1,2})/(\d{1,2})/(69|[789]\d)$", "19$3-$1-$2"),
        (r"^(\d{1,2})/(\d{1,2})/(\d{2})$", "20$3-$1-$2"),
    ):
        iso = F.regexp_replace(iso, shape, form)
    # ten characters as `MM/dd/yyyy`, which is what most cells hold, need no pattern
    plain = (F.length(c) == 10) & (F.substring(c, 3, 1) == "/") & (F.substring(c, 6, 1) == "/") & (F.translate(c, "0123456789", "") == "//")
    return F.when(plain, F.concat_ws("-", F.substring(c, 7, 4), F.substring(c, 1, 2), F.substring(c, 4, 2)).try_cast("date")).otherwise(
        F.regexp_extract(iso, r"^\d{4}-\d{1,2}-\d{1,2}$", 0).try_cast("date"))


def as_date_error(c: Column) -> Column:
    return F.coalesce(strip(c) != "", F.lit(False)) & as_date(c).isNull()


def as_int(c: Column) -> Column:
    """Whole numbers only; an empty cell is null, a blank-but-present one is 0."""
    return F.when(c != "", _number(c, "int"))


def as_int_error(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False)) & as_int(c).isNull()


def derive_status(section: Column, sentinel: Column, move_out: Column) -> Column:
    return (
        F.when(section == "future", "future")
        .when(sentinel == "VACANT", "vacant")
        .when(sentinel == "MODEL", "model")
        .when(sentinel == "DOWN", "down")
        .when(move_out.isNotNull(), "notice")
        .otherwise("occupied")
    )


def derive_asset_key(code: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(code, r"^\d+", 0), F.lit("")), code)


def derive_book_type(code: Column) -> Column:
    low = F.lower(code)
    return (
        F.when(low.endswith("land"), "land")
        .when(low.endswith("c"), "commercial")
        .when(low.endswith("a"), "affordable")
        .when(low.endswith("r"), "residential")
        .otherwise("other")
    )


def is_concession(code: Column) -> Column:
    return code.like("CON%")


def is_occupied(status: Column) -> Column:
    return status.isin(*S.OCCUPIED_STATUSES)


def quadrant(capture: Column, occ: Column, capture_th: Column, occ_th: Column) -> Column:
    """Equality with a threshold is the high side; null when either axis is null."""
    rich, full = capture >= capture_th, occ >= occ_th
    return (
        F.when(capture.isNull() | occ.isNull(), F.lit(None).cast("string"))
        .when(rich & full, "performing")
        .when(~rich & full, "leaking")
        .when(rich & ~full, "vacancy_led")
        .otherwise("distressed")
    )


def ratio(num: Column, den: Column, digits: int) -> Column:
    """`round(num / nullif(den, 0), digits)` with at least twelve fractional digits kept
    before the rounding. `num` and `den` are counts or money."""
    wide = "decimal(24,2)"
    d = den.cast("decimal(22,2)")
    return F.round(num.cast(wide) / F.nullif(d, F.lit(0).cast("decimal(22,2)")), digits)


def percent(num: Column, den: Column) -> Column:
    return ratio(num * F.lit(100), den, 2)


# Fixed pattern: what counts as a figure.
_FIGURE = r"^-?\$?\(?-?[\d,]*\.?\d+\)?%?$"


def normalise_figure(c: Column) -> Column:
    """`96.00`, `96`, `96%` and `$96.00` become `96`; `(x)` is negative; text is case-folded."""
    s = strip(c)
    negative = s.startswith("(") & s.endswith(")")
    bare = F.translate(F.btrim(s, F.lit("()")), ",$%", "")
    whole = F.regexp_extract(bare, r"^-?0*(\d*?)(?:\.(\d*?)0*)?$", 1)
    frac = F.regexp_extract(bare, r"^-?0*(\d*?)(?:\.(\d*?)0*)?$", 2)
    digits = F.concat(
        F.when(whole == "", "0").otherwise(whole),
        F.when(frac == "", "").otherwise(F.concat(F.lit("."), frac)),
    )
    minus = bare.startswith("-")
    sign = F.when(
        negative, F.when(~minus & (digits != "0"), "-").otherwise("")
    ).otherwise(F.when(minus, "-").otherwise(""))
    is_number = s.rlike(_FIGURE) & bare.rlike(r"^-?\d*\.?\d+$")
    return F.when(is_number, F.concat(sign, digits)).otherwise(F.lower(s))


def like_escape(term: str) -> str:
    """Escape the LIKE metacharacters of a search term, for the default `\\` escape."""
    return "".join("\\" + ch if ch in "\\%_" else ch for ch in term)


def contains_term(c: Column, term: str) -> Column:
    return c.ilike(f"%{like_escape(term)}%")


def trigrams(c: Column) -> Column:
    """Distinct 3-grams of each lower-cased word padded with two leading and one trailing blank."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1),
            lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)),
        ),
    )
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    ga, gb = trigrams(a), trigrams(b)
    union = F.size(F.array_union(ga, gb))
    return F.when(union == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(ga, gb)).cast("double") / union
    )


def estimate_tokens(text: Column) -> Column:
    return tokens_of_length(F.length(text))


def tokens_of_length(length: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(length / F.lit(4))).cast("bigint")


def canonical_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """One row as JSON: keys sorted, nulls dropped, decimals as strings, ISO dates."""
    types = {f.name: f.dataType for f in df.schema.fields}
    fields = []
    for name in sorted(columns or df.columns):
        c = F.col(name)
        fields.append((c.cast("string") if isinstance(types[name], T.DecimalType) else c).alias(name))
    return F.to_json(F.struct(*fields))


def payload_sha256(df: DataFrame, columns: list[str] | None = None) -> Column:
    return F.sha2(canonical_json(df, columns), 256)


def priority_rank(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)


def severity_rank(c: Column) -> Column:
    return F.when(c == "error", 0).when(c == "warning", 1).otherwise(2)


def fmt_money(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 2))

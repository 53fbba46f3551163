"""Normalising photo metadata, column by column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelquarry.functions.geometry import gcd
from pixelquarry.functions.text import sql_text

_DATE = r"^\s*(\d+):\s*(\d+):\s*(\d+)\s+(\d+):\s*(\d+):\s*(\d+)"
FILLER_COMMENT = "User comments"
MAP_URL = "https://opentopomap.org/#marker=15/{lat}/{lng}"


def photo_date(raw: str) -> Column:
    """``y:m:d h:m:s`` as a timestamp without zone; NULL unless all six numbers are there and the year is past 1600."""
    part = [f"try_cast(regexp_extract({raw}, r'{_DATE}', {i}) AS int)" for i in range(1, 7)]
    return F.expr(f"CASE WHEN {part[0]} > 1600 THEN try_make_timestamp_ntz({', '.join(part)}) END")


def reduced(num: str, den: str) -> tuple[Column, Column]:
    """A fraction divided by its greatest common divisor; zero parts leave it as it is, signs stay."""
    g = gcd(f"abs({num})", f"abs({den})")
    zero = f"{num} = 0 OR {den} = 0"
    return F.expr(f"CASE WHEN {zero} THEN {num} ELSE {num} div {g} END"), F.expr(f"CASE WHEN {zero} THEN {den} ELSE {den} div {g} END")


def fraction_value(num: str, den: str) -> Column:
    return F.expr(f"try_divide(cast({num} AS double), cast({den} AS double))")


def gps_parts(deg: str, minute: str, sec: str) -> dict[str, str]:
    """Degrees, minutes, seconds with fractions spread down to the next unit."""
    both_zero = f"({minute} = 0 AND {sec} = 0)"
    whole = f"cast(cast({deg} AS bigint) AS double)"
    d = f"(CASE WHEN {both_zero} THEN {whole} ELSE {deg} END)"
    m = f"(CASE WHEN {both_zero} THEN 60 * abs({deg} - {whole}) ELSE {minute} END)"
    whole_m = f"cast(cast({m} AS bigint) AS double)"
    s = f"(CASE WHEN {sec} = 0 THEN 60 * abs({m} - {whole_m}) ELSE {sec} END)"
    return {"deg": d, "min": f"(CASE WHEN {sec} = 0 THEN {whole_m} ELSE {m} END)", "sec": s}


def gps_decimal(ref: str, deg: str, minute: str, sec: str) -> Column:
    p = gps_parts(deg, minute, sec)
    value = f"({p['deg']} + {p['min']} / 60 + {p['sec']} / 3600)"
    return F.expr(f"CASE WHEN upper({ref}) IN ('S', 'W') THEN -{value} ELSE {value} END")


def map_url(lat: Column, lng: Column, template: str = MAP_URL) -> Column:
    text = F.replace(F.lit(template), F.lit("{lat}"), F.format_string("%.5f", lat))
    return F.replace(text, F.lit("{lng}"), F.format_string("%.5f", lng))


def dms_text(lat: tuple[str, str, str, str], lng: tuple[str, str, str, str]) -> Column:
    """``d° m' s'' ref / ...`` with whole numbers."""
    texts = []
    for ref, deg, minute, sec in (lat, lng):
        p = gps_parts(deg, minute, sec)
        whole = [F.expr(f"cast(rint({p[k]}) AS bigint)") for k in ("deg", "min", "sec")]
        texts.append(F.format_string("%d° %d' %d'' %s", *whole, F.col(ref)))
    return F.concat_ws(" / ", *texts)


def altitude(num: str, den: str, ref: str) -> Column:
    return F.expr(f"try_divide(cast({num} AS double), cast({den} AS double)) * IF({ref} = 1, -1, 1)")


def camera_name(make: str, model: str) -> Column:
    """Model, preceded by the maker's first word unless the model already holds it."""
    first = f"substring_index({make}, ' ', 1)"
    lead = f"IF(instr({make}, ' ') > 1, {first}, {make})"
    return F.expr(
        f"CASE WHEN {model} IS NULL OR {model} = '' THEN {model} WHEN {make} IS NULL OR {make} = '' OR instr({model}, {lead}) > 0 THEN {model} "
        f"ELSE concat({lead}, ' ', {model}) END"
    )


def present(text: str) -> str:
    return f"nullif(trim({text}), '')"


def best_comment(user: str, description: str, embedded: str) -> Column:
    """First non-blank of user comment (without the filler text), description, embedded comment."""
    return F.expr(f"coalesce(nullif({present(user)}, {sql_text(FILLER_COMMENT)}), {present(description)}, {present(embedded)})")


def mostly_plain(text: str) -> Column:
    """Byte text counts as readable: at least 7 characters, more than 80 % letters, digits, blank, comma, dot."""
    plain = f"length(regexp_replace({text}, '[^a-zA-Z0-9 ,.]', ''))"
    return F.expr(f"length({text}) >= 7 AND {plain} > length({text}) * 8 div 10")


def rotation(orientation: str, width: str, height: str, thumb_w: str, thumb_h: str, current: str = "0") -> Column:
    """Degrees from the orientation tag; ignored if thumbnail and image disagree on landscape."""
    disagree = f"{thumb_w} > 0 AND {thumb_h} > 0 AND ({width} > {height}) <> ({thumb_w} > {thumb_h})"
    return F.expr(
        f"CASE WHEN {disagree} THEN {current} WHEN {orientation} = 1 THEN 0 WHEN {orientation} = 3 THEN 180 WHEN {orientation} = 6 THEN 90 "
        f"WHEN {orientation} = 8 THEN 270 ELSE {current} END"
    )


def raw_rotation(flip: str, width: str, height: str, current: str = "0") -> Column:
    """Degrees from the flip bits of a camera-raw file, only while it is still landscape."""
    return F.expr(f"CASE WHEN {width} >= {height} AND ({flip} & 4) <> 0 THEN IF(({flip} & 1) <> 0, 270, 90) ELSE {current} END")


def flash_fired(tag: str) -> Column:
    return F.expr(f"coalesce({tag} & 1, 0) = 1")

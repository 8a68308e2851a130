"""Column expressions shared by every operator.

All of them stay inside Catalyst: no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values -------------------------------------------------------------
PALETTE = (
    "#6EF0D4", "#78B9FF", "#FFB870", "#C8A2FF", "#FF8DA1", "#90F184",
    "#FFD76C", "#80E1FF", "#F4A6FF", "#FFA07A", "#B8F0DE", "#A7BFFF",
)
PIXEL_SIZE_UM = 0.2125
PROTEIN_PREFIXES = ("PROTEIN_", "PROTEIN:", "ADT_", "ADT:", "AB_", "AB:")
SIGNAL_TOKENS = {
    "artifact_signal": ("artifact", "blur", "empty", "fold", "low_quality", "background"),
    "tumor_signal": ("tumor", "carcinoma", "invasive", "dcis", "epithel"),
    "inflammation_signal": ("immune", "inflamm", "macrophage", "lymphocyte", "plasma"),
    "stroma_signal": ("stroma", "fibro", "collagen", "vascular", "endothel"),
}
AMBIGUOUS_LABELS = ("unknown", "ambiguous", "unassigned", "other")
# ---------------------------------------------------------------------------

# Plain decimal notation only: Java would also take "1d", "2f" and hex floats.
_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_LONG_LIMIT = 9.2e18


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pick_column(df: DataFrame, candidates: Sequence[str], required: str | None = None) -> str | None:
    """First candidate present in ``df``, ignoring case, blanks and dashes.

    With ``required`` (a description) a miss raises instead of returning None.
    """
    def key(name: str) -> str:
        return name.strip().lower().replace(" ", "_").replace("-", "_")

    present = {key(name): name for name in df.columns}
    hit = next((present[key(c)] for c in candidates if key(c) in present), None)
    if hit is None and required:
        raise ValueError(f"no column for {required}; looked for {list(candidates)}")
    return hit


def stripped(c) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(_col(c).cast("string"), r"(?U)^\s+|\s+$", "")


def _parsed(c) -> Column:
    text = stripped(c)
    return F.when(text.rlike(_DECIMAL), text.try_cast("double"))


def safe_double(c, default: float = 0.0) -> Column:
    """Text to DOUBLE; missing, unreadable and non-finite become ``default``."""
    v = _parsed(c)
    return F.coalesce(F.when(F.abs(v) < float("inf"), v), F.lit(float(default)))


def finite_or(c, default: float = 0.0) -> Column:
    """The same rule for a column that is already DOUBLE."""
    v = _col(c)
    return F.coalesce(F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v), F.lit(float(default)))


def safe_long(c, default: int = 0) -> Column:
    """Text to BIGINT, truncating fractions."""
    v = _parsed(c)
    return F.coalesce(F.when(F.abs(v) < _LONG_LIMIT, v).cast("bigint"), F.lit(default).cast("bigint"))


def canonical_id(c) -> Column:
    """Trimmed id; ``3``, ``"3.0"`` and ``" 3 "`` become ``"3"``, blank becomes null."""
    text = stripped(c)
    v = _parsed(c)
    whole = F.coalesce(F.when(F.abs(v) < _LONG_LIMIT, v).cast("bigint").cast("string"),
                       F.when(F.abs(v) < 1e37, text).try_cast("decimal(38,0)").cast("string"))
    return F.coalesce(whole, F.nullif(text, F.lit("")))


def normalize_cluster_label(c) -> Column:
    """Cluster label as text, ``""`` when missing."""
    return F.coalesce(canonical_id(c), F.lit(""))


def json_cell(c, schema: str, default: Column | None = None) -> Column:
    """Parse a JSON text column; blank or invalid text gives ``default``."""
    text = F.trim(_col(c))
    ok = (text != "") & F.try_parse_json(text).isNotNull()
    parsed = F.when(ok, F.from_json(text, schema))
    return parsed if default is None else F.coalesce(parsed, default)


def barcode_stem(c) -> Column:
    """Barcode without the part after its last dash."""
    return F.regexp_replace(_col(c), r"-[^-]*$", "")


def palette_color(structure_id) -> Column:
    colours = F.array(*[F.lit(p) for p in PALETTE])
    return F.element_at(colours, (F.pmod(_col(structure_id).cast("int") - 1, F.lit(len(PALETTE))) + 1).cast("int"))


def hex_to_rgb(c) -> Column:
    digits = F.regexp_replace(F.trim(_col(c)), "^#+", "")
    return F.array(*[F.conv(F.substring(digits, i, 2), 16, 10).cast("int") for i in (1, 3, 5)])


def selection_name(structure_id, name, component, polygon, single) -> Column:
    base = F.trim(F.concat(F.lit("S"), _col(structure_id).cast("string"), F.lit(" "),
                           F.regexp_replace(_col(name), r"[\[\]]", "")))
    part = F.concat(F.lit(" #"), _col(component).cast("string"), F.lit("."), _col(polygon).cast("string"))
    return F.when(_col(single), base).otherwise(F.concat(base, part))


def slug(c, max_len: int = 96) -> Column:
    s = F.regexp_replace(_col(c), r"[^A-Za-z0-9._-]+", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.substring(F.coalesce(F.nullif(s, F.lit("")), F.lit("contour")), 1, max_len)


def _little_endian_u32(hex_digest: Column, first_byte: int) -> Column:
    parts = [F.substring(hex_digest, 2 * (first_byte + b) + 1, 2) for b in (3, 2, 1, 0)]
    return F.conv(F.concat(*parts), 16, 10).cast("double")


def stable_jitter(c, scale: float = 0.08) -> tuple[Column, Column]:
    """Two repeatable offsets in ``[-scale/2, scale/2)`` drawn from a SHA-1."""
    h = F.sha1(_col(c).cast("string"))
    return tuple((_little_endian_u32(h, b) / F.lit(float(2**32)) - 0.5) * scale for b in (0, 4))


def signal_bucket(label) -> Column:
    text = F.lower(_col(label))
    out = None
    for bucket, tokens in SIGNAL_TOKENS.items():
        hit = text.rlike("|".join(tokens))
        out = F.when(hit, F.lit(bucket)) if out is None else out.when(hit, F.lit(bucket))
    return out


def feature_modality(name, explicit: Iterable[str] = (), prefixes: Sequence[str] = PROTEIN_PREFIXES) -> Column:
    upper = F.upper(_col(name))
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | upper.startswith(p.upper())
    named = sorted({str(e).upper() for e in explicit})
    if named:
        hit = hit | upper.isin(named)
    return F.when(hit, F.lit("protein")).otherwise(F.lit("rna"))


def check_pixel_size(p: float) -> float:
    p = float(p)
    if not p > 0:
        raise ValueError(f"pixel size must be positive, got {p}")
    return p


def um_to_px(c, pixel_size_um: float = PIXEL_SIZE_UM) -> Column:
    return _col(c) * (1.0 / check_pixel_size(pixel_size_um))


def px_to_um(c, pixel_size_um: float = PIXEL_SIZE_UM) -> Column:
    return _col(c) * check_pixel_size(pixel_size_um)


def resolve_pixel_size(metadata, fallback: float = PIXEL_SIZE_UM) -> tuple[Column, Column]:
    """(pixel size, where it came from) per row; metadata wins when present.

    A non-positive metadata value is an error and fails the job.
    """
    m = _col(metadata).cast("double")
    bad = F.raise_error(F.lit("pixel size must be positive")).cast("double")
    size = F.when(m.isNull(), F.lit(check_pixel_size(fallback))).when(m > 0, m).otherwise(bad)
    return size, F.when(m.isNull(), F.lit("fallback")).otherwise(F.lit("metadata"))


def transform_chain(x, y, chain: Sequence[dict]) -> tuple[Column, Column]:
    """Apply identity, scale, translation and swap_axes steps in order."""
    x, y = _col(x), _col(y)
    for step in chain:
        kind = step["type"]
        if kind == "scale":
            x, y = x * float(step["x"]), y * float(step["y"])
        elif kind == "translation":
            x, y = x + float(step["x"]), y + float(step["y"])
        elif kind == "swap_axes":
            x, y = y, x
        elif kind != "identity":
            raise ValueError(f"unknown transform {kind!r}")
    return x, y


Affine = tuple[float, float, float, float, float, float]  # row major 2x3


def apply_affine(x, y, m: Affine) -> tuple[Column, Column]:
    a, b, c, d, e, f = (float(v) for v in m)
    x, y = _col(x), _col(y)
    return x * a + y * b + c, x * d + y * e + f


def invert_affine(m: Affine) -> Affine:
    a, b, c, d, e, f = (float(v) for v in m)
    det = a * e - b * d
    if det == 0:
        raise ValueError("affine matrix is singular")
    ia, ib, id_, ie = e / det, -b / det, -d / det, a / det
    return (ia, ib, -(ia * c + ib * f), id_, ie, -(id_ * c + ie * f))


def rescale_affine(m: Affine, sx: float, sy: float) -> Affine:
    """``m`` for coordinates counted on a pyramid level ``sx`` by ``sy`` coarser."""
    a, b, c, d, e, f = m
    return (a * sx, b * sy, c, d * sx, e * sy, f)


def density_proxy_affine(pixel_size_um: float, scale_um_per_px: float, x_min: float, y_min: float) -> Affine:
    """Slide pixel to proxy-raster pixel."""
    k = check_pixel_size(pixel_size_um) / scale_um_per_px
    return (k, 0.0, -x_min / scale_um_per_px, 0.0, k, -y_min / scale_um_per_px)


def pathway_text(entries) -> Column:
    """``ARRAY<STRUCT<name, score>>`` as ``name:0.000;name:0.000``."""
    return F.array_join(F.transform(_col(entries), lambda e: F.format_string("%s:%.3f", e["name"], e["score"])), ";")


def top_pathways(text, n: int = 3) -> Column:
    """Names at the front of a ``pathway_text`` value."""
    items = F.filter(F.split(F.coalesce(_col(text), F.lit("")), ";"), lambda s: F.trim(s) != "")
    return F.slice(F.transform(items, lambda s: F.substring_index(s, ":", 1)), 1, n)


def json_string(c) -> Column:
    """A string as a quoted JSON scalar."""
    boxed = F.to_json(F.array(_col(c)))
    return F.substring(boxed, F.lit(2), F.length(boxed) - 2)


def canonical_json(m) -> Column:
    """``MAP<STRING,STRING>`` as JSON with sorted keys and ``", "``/``": "`` separators."""
    pairs = F.array_sort(F.map_entries(_col(m)))
    body = F.transform(pairs, lambda e: F.concat(json_string(e["key"]), F.lit(": "), json_string(e["value"])))
    return F.concat(F.lit("{"), F.array_join(body, ", "), F.lit("}"))


def input_hash(m) -> Column:
    return F.sha2(canonical_json(m), 256)


def extract_json_text(raw) -> Column:
    """The JSON object inside model output: a fenced block if any, then first ``{`` to last ``}``."""
    text = F.trim(_col(raw))
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    found = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.nullif(found, F.lit(""))


def text_list(json_text) -> Column:
    """JSON of any shape to ``ARRAY<STRING>`` with blanks dropped.

    null gives [], a scalar [s], an object ``key: value`` lines, an array its items.
    """
    raw = _col(json_text)
    v = F.try_parse_json(raw)
    kind = F.substring_index(F.schema_of_variant(v), "<", 1)
    items = F.transform(F.from_json(raw, "array<string>"), lambda s: F.trim(s))
    pairs = F.transform(F.map_entries(F.from_json(raw, "map<string,string>")),
                        lambda e: F.when(F.trim(e["value"]) != "", F.concat(e["key"], F.lit(": "), F.trim(e["value"]))))
    single = F.array(F.trim(F.try_variant_get(v, "$", "string")))
    out = (F.when(v.isNull() | (kind == "VOID"), F.array().cast("array<string>"))
           .when(kind == "ARRAY", items).when(kind == "OBJECT", pairs).otherwise(single))
    return F.filter(out, lambda s: s.isNotNull() & (s != ""))

"""Column functions of map, pyramid and slide arithmetic. All stay inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_LABEL_LIMIT = 2147483647
#: The smallest side that a further pyramid level may have, the range of compressions tried.
LITTLE, COMPRESSIONS = 256, range(2, 33)


def col(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def floor_div(a, b) -> Column:
    """Exact floor of a / b for any sign of a and b > 0."""
    a, b = col(a), col(b)
    return F.call_function("div", a - F.pmod(a, b), b)


def divide_ceil(a, b) -> Column:
    """a / b rounded up, for a >= 0 and b > 0."""
    return floor_div(col(a) + col(b) - 1, b)


def equalize_grid(total, cell) -> Column:
    """The least cell size that cuts total into as many cells as `cell` does; 0 keeps the cell."""
    n = divide_ceil(total, F.greatest(col(cell), F.lit(1)))
    return F.when(col(total) == 0, col(cell)).when(n * col(cell) == col(total), col(cell)).otherwise(divide_ceil(total, F.greatest(n, F.lit(1))))


def round_half_up(x) -> Column:
    """The whole number nearest to x, halves upwards."""
    return F.floor(col(x) + 0.5)


def direction_shift(direction, x, y) -> tuple[Column, Column]:
    """The signed shift of a diagonal direction."""
    d = col(direction)
    return F.when(d.isin("LEFT_UP", "LEFT_DOWN"), -col(x)).otherwise(col(x)), F.when(d.isin("LEFT_UP", "RIGHT_UP"), -col(y)).otherwise(col(y))


def recommended_expansion(sequence, low, high) -> Column:
    """The direction in which the unread part lies behind, by scanning order: rows and columns, plain and snake."""
    s, odd = col(sequence), F.pmod(col(high), F.lit(2)) == 1
    return (
        F.when(s.isin("ROWS_LEFT_TO_RIGHT", "COLUMNS_TOP_TO_BOTTOM"), F.lit("LEFT_UP"))
        .when(s == "ROWS_BY_SNAKE", F.when(odd, "RIGHT_UP").otherwise("LEFT_UP"))
        .when(s == "COLUMNS_BY_SNAKE", F.when(odd, "LEFT_DOWN").otherwise("LEFT_UP"))
    )


def change_rect(kind, rect: tuple, x, y) -> tuple[Column, ...]:
    """(min_x, max_x, min_y, max_y) shifted in a diagonal direction, or dilated by EXPAND."""
    a, b, c, d = (col(v) for v in rect)
    sx, sy = direction_shift(kind, x, y)
    grown = col(kind) == "EXPAND"
    return F.when(grown, a - col(x)).otherwise(a + sx), F.when(grown, b + col(x)).otherwise(b + sx), F.when(grown, c - col(y)).otherwise(c + sy), F.when(grown, d + col(y)).otherwise(d + sy)


def add_index_base(label, base, zero_reserved: bool = True) -> Column:
    """label + base, zeros kept when reserved for background; an error from 2^31 - 1 on."""
    moved = col(label) + col(base)
    moved = F.when(moved >= LONG_LABEL_LIMIT, F.raise_error(F.lit("label overflow")).cast("bigint")).otherwise(moved)
    return F.when(col(label) == 0, F.lit(0).cast("bigint")).otherwise(moved) if zero_reserved else moved


def scale_special(x, special_dim, level_dim) -> Column:
    """A coordinate of a special image carried over to a level: round(x / (sd - 1) * (ld - 1))."""
    sd, ld = F.greatest(col(special_dim), F.lit(2)), F.greatest(col(level_dim), F.lit(1))
    return round_half_up(col(x) / (sd - 1) * (ld - 1))


def scale_roi(low, size, scale) -> tuple[Column, Column]:
    """(min, size) of a side at a level's scale: the minimum rounded, the size rounded up."""
    return round_half_up(col(low) * col(scale)), F.ceil(col(size) * col(scale))


def rotate_point(angle, x, y, w, h, pixel: bool = False) -> tuple[Column, Column]:
    """Coordinates in the image rotated clockwise by angle -> coordinates in its parent of w x h; pixel: of whole pixels."""
    a, x, y, k = col(angle), col(x), col(y), 1 if pixel else 0
    w, h = col(w) - k, col(h) - k
    return F.when(a == 90, y).when(a == 180, w - x).when(a == 270, w - y).otherwise(x), F.when(a == 90, h - x).when(a == 180, h - y).when(a == 270, x).otherwise(y)


def rotation_reverse(angle) -> Column:
    ok = col(angle).isin(0, 90, 180, 270)
    return F.when(ok, F.pmod(360 - col(angle), F.lit(360))).otherwise(F.raise_error(F.lit("angle")).cast("int"))


def very_little_sizes(w, h) -> Column:
    w, h = col(w), col(h)
    return (w < 1) | (h < 1) | ((w < LITTLE) & (h < LITTLE))


def number_of_resolutions(w, h, compression, least) -> Column:
    """Levels until both sides are below least, dividing by the compression; 1 at least."""
    w, h, c, m = col(w), col(h), col(compression), col(least)
    start = F.struct(F.greatest(w, h).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("done"))

    def step(state: Column, _: Column) -> Column:
        next_side = floor_div(state["s"], c)
        return F.when(state["done"], state).otherwise(F.struct(next_side.alias("s"), (state["n"] + 1).alias("n"), (next_side < m).alias("done")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(63)), start, step)["n"]


def is_dimensions_relation_correct(w, h, next_w, next_h, compression) -> Column:
    """Whether the next level's sides are the quotients, or one more."""
    def side(a, b):
        q = floor_div(a, compression)
        return (col(b) == q) | (col(b) == q + 1)

    return side(w, next_w) & side(h, next_h)


def find_compression(w, h, next_w, next_h) -> Column:
    """The smallest compression from 2 to 32 that explains the next level's sides, else 0."""
    return F.coalesce(*(F.when(is_dimensions_relation_correct(w, h, next_w, next_h, F.lit(c)), F.lit(c)) for c in COMPRESSIONS), F.lit(0))


def tile_of(direction, tile, x, y) -> tuple[Column, Column, Column, Column]:
    """(min_x, max_x, min_y, max_y) of the tile that holds a point, the grid growing from one of four corners."""
    def along(v, back):
        v, t = col(v), col(tile)
        low = F.when(back, v - t + 1 + F.pmod(-v - 1, t)).otherwise(v - F.pmod(v, t))
        return low, low + t - 1

    d = col(direction)
    x0, x1 = along(x, d.isin("LEFT_UP", "LEFT_DOWN"))
    y0, y1 = along(y, d.isin("LEFT_UP", "RIGHT_UP"))
    return x0, x1, y0, y1


def max_level(compression, base) -> Column:
    """The largest k with base^k <= compression (0 below)."""
    c, b = col(compression), col(base)
    start = F.struct(F.lit(1.0).alias("p"), F.lit(0).alias("k"))

    def step(s: Column, _: Column) -> Column:
        return F.when(s["p"] * b <= c, F.struct((s["p"] * b).alias("p"), (s["k"] + 1).alias("k"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(62)), start, step)["k"]


def safe_floor(x) -> Column:
    """The floor, but the next whole number if x is within 1e-7 of it."""
    x = col(x)
    return F.when(F.ceil(x) - x < 1e-7, F.ceil(x)).otherwise(F.floor(x))


def svs_level_ifd(level) -> Column:
    """The directory of a level when the second directory is a thumbnail."""
    return F.when(col(level) < 1, col(level)).otherwise(col(level) + 1)


def whole_slide_dim_x(map_x, map_y, label_x, label_y) -> Column:
    return col(map_x) + round_half_up(col(label_x) * col(map_y) / col(label_y))


def gray(r, g, b) -> Column:
    return 0.3 * col(r) + 0.59 * col(g) + 0.11 * col(b)


def rescale_precision(v, max_a, max_b) -> Column:
    return col(v) * col(max_b) / col(max_a)


def parse_number_if_possible(s) -> tuple[Column, Column]:
    """(kind, value): int, double or string, as the first that parses."""
    s = F.trim(col(s))
    whole, real = s.try_cast("int"), s.try_cast("double")
    return F.when(whole.isNotNull(), "int").when(real.isNotNull(), "double").otherwise("string"), F.coalesce(whole.cast("double"), real)


def pyramid_format(path) -> Column:
    """SVS by extension, any other image by the general reader."""
    return F.when(F.lower(F.regexp_extract(col(path), r"\.([^./]*)$", 1)) == "svs", "SVS").otherwise("IMAGE_IO")


FORMULA_NAMES = ("m", "p", "snake")


def recommended_frames(formula: str, m, p, snake) -> Column:
    """A number or a conditional formula of m, p and snake; whitelisted tokens only, never evaluated as code. The result must be positive."""
    import re

    tokens = re.findall(r"\s*(\d+(?:\.\d+)?|[A-Za-z_]\w*|[-+*/()?:<>=!&|])", formula)
    if "".join(tokens) != re.sub(r"\s", "", formula) or any(re.match(r"[A-Za-z_]", t) and t not in FORMULA_NAMES for t in tokens):
        raise ValueError(f"unknown token in formula {formula!r}")
    if "?" in tokens:
        cond, rest = formula.split("?", 1)
        yes, no = rest.rsplit(":", 1)
        sql = f"CASE WHEN {cond} THEN {yes} ELSE {no} END"
    else:
        sql = formula
    expr = re.sub(r"\b(m|p|snake)\b", lambda k: f"s.{k[1]}", sql)
    rounded = F.expr(f"transform(array(named_struct('m', {_sql(m)}, 'p', {_sql(p)}, 'snake', {_sql(snake)})), s -> floor(({expr}) + 0.5D))[0]")
    return F.when(rounded > 0, rounded).otherwise(F.raise_error(F.lit("the formula's result must be positive")).cast("bigint"))


def _sql(x) -> str:
    return x if isinstance(x, str) else "true" if x is True else "false" if x is False else repr(x)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))

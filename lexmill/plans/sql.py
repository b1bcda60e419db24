"""Pieces of the DuckDB twins."""

TOKEN = r"[\p{L}\p{N}_''-]+"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{TOKEN}')"


def words(x: str, pattern: str = "[a-z]+") -> str:
    return f"regexp_extract_all(lower({x}), '{pattern}')"


def slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def edit_similarity(a: str, b: str, guard: bool = True) -> str:
    """For ASCII text: the twin's distance counts bytes."""
    far = f"WHEN abs(length({a}) - length({b})) > greatest(4, floor(0.6 * greatest(length({a}), length({b})))) THEN 0.0" if guard else ""
    return (
        f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 WHEN least(length({a}), length({b})) = 0 THEN 0.0 {far} "
        f"ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE END"
    )


def grams(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) >= {n} THEN list_transform(range(1, length({x}) - {n - 2}), lambda i: substr({x}, i, {n})) ELSE []::VARCHAR[] END"


def dice(a: str, b: str) -> str:
    x, y = (f"list_distinct({grams(f"('^' || {t} || '$')", 3)})" for t in (a, b))
    return f"CASE WHEN length({a}) < 2 OR length({b}) < 2 THEN ({a} = {b})::INT::DOUBLE ELSE 2 * len(list_intersect({x}, {y})) / (len({x}) + len({y}))::DOUBLE END"


def values(rows: list[tuple], names: str) -> str:
    """The same relation for both engines."""

    def one(v: object) -> str:
        if v is None:
            return "NULL"
        return str(v) if isinstance(v, int) and not isinstance(v, bool) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v).upper() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({names})"

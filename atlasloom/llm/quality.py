r"""Quality rules: a short-circuit cascade in DataFrame and SQL functions only.

Every rule is a Boolean SQL expression over features of the text. Its cost and its selectivity are estimated on a
bounded sample (`sample_rows`, 500 by default, of at most 64 KB) in a second, warm run; then the rules run as one CASE
in order of rejection per cost, so that a row leaves at the first rule that rejects it, and the features that only later
rules ask for are not evaluated. The order decides speed alone: a row is kept if no rule rejects it, whichever the
order, and every row and every whole text is judged.

Defined cases: a null text counts as empty (no words, so the length rule rejects it); repeated rows are judged each
for itself; an empty table gives an empty result; further columns, whatever their names, pass through untouched,
since no helper column is ever added to the input.
"""

from __future__ import annotations

import string
import time
from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A position takes the low bits of a sort key, a hash of the window the others.
POSITION_BITS = 20
LOW = (1 << POSITION_BITS) - 1
SAMPLE_BYTES = 1 << 16
EMPTY = "''"
#: Features that a report gives for every row.
WANTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates `value` once and names it inside `body`."""
    return f"transform(array({value}), {name} -> {body})[0]"


def words_sql(text: str) -> str:
    return rf"array_remove(split({text}, '[\\x20\\x09-\\x0D]+'), '')"


def repeated_words_sql(words: str) -> str:
    """Words inside 3-word windows that occur twice or more in the text.

    Sort keys hold a window's hash above its position, so equal windows become neighbours in one primitive sort. The
    words of neighbours with equal hashes are compared; should hashes collide, or a text be too long for the position
    bits, that row alone sorts the windows themselves. The result is exact either way.
    """
    low, high = f"{LOW}L", f"(-1L - {LOW}L)"
    same = f"((get(_s, _j + 1) & {high}) = (_k & {high}) OR (_j > 0 AND (get(_s, _j - 1) & {high}) = (_k & {high})))"
    differ = "NOT (_w[_p] = _w[_q] AND _w[_p + 1] = _w[_q + 1] AND _w[_p + 2] = _w[_q + 2])"
    at = lambda j: f"CAST(_d[{j}] & {low} AS INT)"
    collide = f"exists(sequence(0, size(_d) - 2), _j -> (_d[_j] & {high}) = (_d[_j + 1] & {high}) AND {let(at('_j'), '_p', let(at('_j + 1'), '_q', differ))})"
    covered = lambda pos: f"aggregate({pos}, named_struct('n', 0L, 'last', -9L), (_a, _x) -> named_struct('n', _a.n + least(3L, _x - _a.last), 'last', _x), _a -> _a.n)"
    windows = "array_sort(transform(sequence(0, size(_w) - 3), _i -> named_struct('a', _w[_i], 'b', _w[_i + 1], 'c', _w[_i + 2], 'p', CAST(_i AS BIGINT))))"
    equal = lambda o: f"coalesce(get(_z, {o}).a = _e.a AND get(_z, {o}).b = _e.b AND get(_z, {o}).c = _e.c, false)"
    plain = let(windows, "_z", covered(f"sort_array(transform(filter(_z, (_e, _j) -> {equal('_j + 1')} OR (_j > 0 AND {equal('_j - 1')})), _e -> _e.p))"))
    keys = f"sort_array(transform(sequence(0, size(_w) - 3), _i -> (xxhash64(_w[_i], _w[_i + 1], _w[_i + 2]) & {high}) | CAST(_i AS BIGINT)))"
    quick = let(keys, "_s", let(f"filter(_s, (_k, _j) -> coalesce({same}, false))", "_d", f"CASE WHEN size(_d) = 0 THEN 0L WHEN {collide} THEN -1L ELSE {covered(f'sort_array(transform(_d, _k -> _k & {low}))')} END"))
    chosen = let(quick, "_r", f"CASE WHEN _r >= 0 THEN _r ELSE {plain} END")
    return let(words, "_w", f"CASE WHEN size(_w) < 3 THEN 0L WHEN size(_w) > {LOW} THEN {plain} ELSE {chosen} END")


def features(text: str = "text", words: str | None = None) -> dict[str, str]:
    """SQL of the features that rules may name; each is evaluated only where a rule asks for it. `words` names the words where they are at hand."""
    t = f"coalesce({text}, '')"
    words = words or words_sql(t)
    lines = rf"filter(split({t}, '\n'), _l -> _l RLIKE '[^\\x20\\x09-\\x0D]')"
    return {
        "n_words": f"CAST(size({words}) AS BIGINT)",
        "word_chars": f"CAST(char_length(array_join({words}, '')) AS BIGINT)",
        "n_symbols": f"CAST(regexp_count({t}, '[#*$%&|<>]') AS BIGINT)",
        "n_dup_lines": let(lines, "_ls", "CAST(size(_ls) - size(array_distinct(_ls)) AS BIGINT)"),
        "n_lines": f"CAST(size({lines}) AS BIGINT)",
        "n_repeat_words": repeated_words_sql(words),
        "n_chars_all": f"CAST(char_length({t}) AS BIGINT)",
        "n_capitals": f"CAST(char_length({t}) - char_length(regexp_replace({t}, '[A-Z]+', '')) AS BIGINT)",
    }


@dataclass(frozen=True)
class Rule:
    """Rejects a document where `reject`, SQL over `{feature}` placeholders, is true."""

    name: str
    reject: str

    def names(self) -> set[str]:
        return {name for _, name, _, _ in string.Formatter().parse(self.reject) if name}

    def sql(self, known: dict[str, str]) -> str:
        return f"coalesce({self.reject.format(**known)}, false)"


#: Production rules. The first two are the base of the contract; the others bound symbols, shouting, word length and repeated lines.
RULES = (
    Rule("too_short", "{n_words} < 50"),
    Rule("repeated_windows", "100 * {n_repeat_words} > 50 * {n_words}"),
    Rule("symbols", "10 * {n_symbols} > {n_words}"),
    Rule("capitals", "100 * {n_capitals} > 40 * {n_chars_all}"),
    Rule("word_length", "{word_chars} < 2 * {n_words} OR {word_chars} > 14 * {n_words}"),
    Rule("repeated_lines", "100 * {n_dup_lines} > 50 * {n_lines}"),
)


#: Seconds that a rule is taken to cost at least.
LEAST_COST = 1e-4


def ordered(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = 500, ready: Collection[str] = ()) -> list[tuple[Rule, float, float]]:
    """Rules by rejection per cost on a bounded sample, with the seconds and the rejected share of each; features that are `ready` cost nothing."""
    known = features(text)
    short = docs.where(F.coalesce(F.octet_length(text), F.lit(0)) <= SAMPLE_BYTES)

    def tried(sql: str) -> tuple[float, list[bool]]:
        """Seconds for the first rows, of which the driver gets one Boolean each; later partitions are not read. The first run compiles, the second counts."""
        for _ in range(2):
            began = time.perf_counter()
            got = [r[0] for r in short.select(F.expr(sql)).take(sample_rows)]
        return time.perf_counter() - began, got

    scan = tried(f"octet_length({text}) < 0")[0]
    found = []
    for rule in rules:
        seconds, got = tried(rule.sql(known))
        found.append((rule, LEAST_COST if rule.names() <= set(ready) else max(seconds - scan, LEAST_COST), sum(got) / max(1, len(got))))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))


def verdict_sql(rules, known: dict[str, str]) -> str:
    """Name of the first rule that rejects a row, null where none does; later rules are not evaluated."""
    return "CASE " + " ".join(f"WHEN {r.sql(known)} THEN '{r.name}'" for r in rules) + " END" if rules else "CAST(NULL AS STRING)"


def keep_good(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = 500) -> DataFrame:
    """The rows that no rule rejects, with the input's columns."""
    order = [r for r, _, _ in ordered(docs, rules, text, sample_rows)]
    return docs.filter(f"{let(words_sql(f'coalesce({text}, {EMPTY})'), '_ws', verdict_sql(order, features(text, '_ws')))} IS NULL")


def report(docs: DataFrame, wanted: tuple[str, ...] = WANTED, key: str = "doc_id", rules=RULES, text: str = "text", sample_rows: int = 500) -> DataFrame:
    """The wanted features of every row and the cascade's verdict: (key, wanted..., rejected_by).

    Words are split once. What is wanted is computed once and the cascade reads it; what only rules ask for stays
    inside the cascade, so a row that an earlier rule rejects does not pay for it.
    """
    order = [r for r, _, _ in ordered(docs, rules, text, sample_rows, wanted)]
    known = features("_t", "_ws")
    rows = docs.select(F.col(key), F.col(text).alias("_t")).select(key, "_t", F.expr(words_sql(f"coalesce(_t, {EMPTY})")).alias("_ws"))
    rows = rows.select(key, "_t", "_ws", *[F.expr(known[name]).alias(name) for name in wanted])
    return rows.select(key, *wanted, F.expr(verdict_sql(order, known | {name: f"`{name}`" for name in wanted})).alias("rejected_by"))

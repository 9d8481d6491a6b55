"""Secret scan: known patterns plus sliding-window entropy, in DataFrame expressions only.

Base kinds, each found leftmost and non-overlapping: ``assign`` (a credential
word, a separator and a value of six characters or more), ``access`` (AKIA
keys of twenty characters or more) and ``hex`` (24 or more lower-case digits).

The method adds ``entropy`` spans: candidate strings are the maximal runs of
token characters that are at least a window long, once placeholders, alphabet
runs and UUIDs are cut out of them (what is glued to one is measured by itself).
A candidate's character class sets the entropy it has to reach in some window:
digits with a-f or A-F, digits with capitals, or digits with capitals and small
letters. The segments of a run (split at / and +) are candidates too, and of
two more classes: digits with small letters, and letters of both cases; not so
segments made of words and numbers only (a word may end in four digits).
Segments shorter than a window are not measured by themselves. The window slides by one character and
keeps the counts of its characters and sum(c log2 c), both updated for the one
character that enters and the one that leaves; entropy is log2(W) minus that
sum over W. The span reaches from the first to the last window that is dense
enough. Paths none of whose segments is dense by itself, candidates that a base
span covers and segment spans inside the span of a whole run are left out.

A match's place is the length of what regular-expression split leaves before
it plus the matches before, all counted in code points.

Defined results: null text counts as empty (no spans). Rows are scanned one by
one: repeated rows repeat, a null id stays null, extra columns stay, except
that a column named like a result is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the result contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-"
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}" % WINDOW
#: (class pattern, bits a window has to reach), first match counts.
CLASSES = (
    (r"^(?=.*[0-9])(?:[0-9a-f]+|[0-9A-F]+)$", 3.0),
    (r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", 3.5),
    (r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z]).+$", 3.7),
)
ALLOW = (
    r"(?i)example|placeholder|changeme|dummy|sample|xxxx",
    r"(?i)0123456789|abcdefgh|qwertyui",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"^(?:/?[A-Za-z_-]{2,}){2,}(?:/[A-Za-z0-9_-]+)*$",
)
#: Classes of segments only.
SEGMENT = r"[A-Za-z0-9_-]{%d,}" % WINDOW
SEGMENT_CLASSES = CLASSES + (
    (r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z_-]+$", 3.5),
    (r"^(?=.*[A-Z])(?=.*[a-z])[A-Za-z_-]+$", 3.8),
)
# Possessive loops: Java matches them without recursion, however long the run.
_WORD = r"(?:(?:[A-Z]?[a-z]++|[A-Z]++)[0-9]{0,4}+|[0-9]++)"
WORDS = rf"^[_-]*+{_WORD}(?:[_-]++{_WORD})*+[_-]*+$"
#: The path pattern of ALLOW in linear time.
PATH = r"^/?(?:[A-Za-z_-]{4,}+|[A-Za-z_-]{2,}+/[A-Za-z_-]{2,}+)(?:/[A-Za-z0-9_-]++)*+$"
UUID = rf"(?<![0-9A-Za-z]){ALLOW[2]}(?![0-9A-Za-z])"
#: What is cut out of runs, as (pattern, length).
CUT = ((UUID, 36), *((f"(?i){w}", len(w)) for p in ALLOW[:2] for w in p.removeprefix("(?i)").split("|")))
MASK = "[SECRET]"

_SPAN = "struct<start:int,ord:int,stop:int>"
_RUN = "struct<start:int,ord:int,stop:int,m:string>"


def _q(pattern: str) -> str:
    """A pattern as a raw SQL string literal."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _bases(n: str, zero: str, value: str, join: str) -> str:
    """What comes before each piece of ``w`` numbers i below ``n``, and before the end: the ``value`` of all smaller i,
    joined. ``join`` is written with @a and @b, ``value`` with i."""
    both = join.replace("@a", "a").replace("@b", f"({value})")
    return f"""aggregate(sequence(0, CAST(({n} - 1) DIV w AS int)), array({zero}),
        (bs, k) -> array_append(bs, aggregate(sequence(k * w, least({n}, (k + 1) * w) - 1), element_at(bs, -1), (a, i) -> {both})))"""


def _running(n: str, zero: str, value: str, join: str, keep: str, row: str, kind: str) -> str:
    """Array (of ``kind``) of ``row`` for each i below ``n`` for which ``keep`` holds; both may read a.at, the ``value``
    of all smaller i, joined. Folded in pieces of about sqrt(n), so that no array is copied once per row."""
    both = join.replace("@a", "a.at").replace("@b", f"({value})")
    none = f"CAST(array() AS array<{kind}>)"
    pieces = f"""flatten(transform(sequence(0, CAST(({n} - 1) DIV w AS int)), k -> aggregate(
        sequence(k * w, least({n}, (k + 1) * w) - 1), named_struct('at', before[k], 'out', {none}),
        (a, i) -> named_struct('at', {both}, 'out', IF({keep}, array_append(a.out, {row}), a.out)), a -> a.out)))"""
    return f"""IF({n} = 0, {none}, transform(array(CAST(ceil(sqrt({n})) AS int)), w ->
        transform(array({_bases(n, zero, value, join)}), before -> {pieces})[0])[0])"""


def _located(found: str, rest: str, keep: str, ord_: int, text: bool = False) -> str:
    """Spans of the matches ``found`` (array of strings) between the pieces ``rest``; with their ``text`` if asked for."""
    start = f"a.at + length({rest}[i])"
    shown, kind = (f", 'm', {found}[i]", _RUN) if text else ("", _SPAN)
    row = f"named_struct('start', {start}, 'ord', {ord_}, 'stop', {start} + length({found}[i]){shown})"
    return _running(f"size({found})", "0", f"length({rest}[i]) + length({found}[i])", "@a + @b", keep.replace("@match", f"{found}[i]"), row, kind)


def _flags(spans: str, others: str, around: bool = False) -> str:
    """For each of ``spans`` whether one of ``others`` contains it (``around``: whether it contains one of them).
    Both are sorted into one sequence, along which the furthest end so far decides."""
    sign, zero, join, test = ("-", "2147483647", "least(@a, @b)", "a.at <= ev[i].stop") if around else ("", "-1", "greatest(@a, @b)", "a.at >= ev[i].stop")
    events = f"""array_sort(concat(
        transform({others}, o -> named_struct('key', {sign}o.start, 'item', 0, 'stop', o.stop, 'nr', -1)),
        transform({spans}, (o, nr) -> named_struct('key', {sign}o.start, 'item', 1, 'stop', o.stop, 'nr', nr))))"""
    told = _running("size(ev)", zero, f"IF(ev[i].item = 0, ev[i].stop, {zero})", join, "ev[i].item = 1",
                    f"named_struct('nr', ev[i].nr, 'yes', {test})", "struct<nr:int,yes:boolean>")
    return f"""IF(size({spans}) = 0 OR size({others}) = 0, array_repeat(false, size({spans})),
        transform(array({events}), ev -> transform(array_sort({told}), x -> x.yes))[0])"""


def _some(s: str, patterns) -> str:
    return "(" + " OR ".join(f"{s} RLIKE {_q(p)}" for p in patterns) + ")"


def _dense(s: str, classes=CLASSES) -> str:
    """First and last position (window ends) of ``s`` that reach the entropy of its class, by incremental counts."""
    xlogx = "array(" + ", ".join(f"{(c * math.log2(c) if c else 0.0)!r}D" for c in range(WINDOW + 1)) + ")"
    # entropy >= bits  <=>  sum(c log2 c) <= W (log2 W - bits)
    most = "CASE " + " ".join(f"WHEN {s} RLIKE {_q(p)} THEN {WINDOW * (math.log2(WINDOW) - bits)!r}D" for p, bits in classes) + " ELSE -1D END"
    gone = f"""IF(t >= {WINDOW},
        named_struct('n', transform(a.n, (c, k) -> IF(k = ix[t - {WINDOW}], c - 1, c)),
                     's', a.s - f[a.n[ix[t - {WINDOW}]]] + f[a.n[ix[t - {WINDOW}]] - 1]),
        named_struct('n', a.n, 's', a.s))"""
    come = f"""named_struct('n', transform(b.n, (c, k) -> IF(k = ix[t], c + 1, c)),
                            's', b.s + f[b.n[ix[t]] + 1] - f[b.n[ix[t]]])"""
    step = f"""transform(array({gone}), b -> transform(array({come}), d -> named_struct(
        'n', d.n, 's', d.s,
        'first', IF(a.first < 0 AND t >= {WINDOW - 1} AND d.s <= most + 1e-9D, t, a.first),
        'last', IF(t >= {WINDOW - 1} AND d.s <= most + 1e-9D, t, a.last)))[0])[0]"""
    fold = f"""aggregate(sequence(0, size(ix) - 1),
        named_struct('n', array_repeat(0, {len(ALPHABET)}), 's', 0D, 'first', -1, 'last', -1),
        (a, t) -> {step}, a -> named_struct('first', a.first, 'last', a.last))"""
    bound = f"transform(array({xlogx}), f -> {fold})[0]"
    bound = f"transform(array({most}), most -> IF(most < 0, named_struct('first', -1, 'last', -1), {bound}))[0]"
    return f"transform(array(transform(split({s}, ''), ch -> instr('{ALPHABET}', ch) - 1)), ix -> {bound})[0]"


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``secret_spans``: array of (start, ord, stop), ordered by start, then kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kinds = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("cand", CANDIDATE))
    df = docs.withColumn("_t", text)
    df = df.withColumns({f"_{k}": F.expr(f"regexp_extract_all(_t, {_q(p)}, 0)") for k, p in kinds})
    df = df.withColumns({f"_{k}_rest": F.expr(f"IF(size(_{k}) = 0, CAST(array() AS array<string>), split(_t, {_q(p)}, -1))") for k, p in kinds})
    value = f"length(regexp_extract(@match, {_q(ASSIGN)}, 2)) >= {MIN_VALUE}"
    base = ", ".join(_located(f"_{k}", f"_{k}_rest", keep, i) for i, (k, keep) in enumerate((("assign", value), ("access", "true"), ("hex", "true"))))
    df = df.withColumn("_base", F.expr(f"concat({base})"))
    df = df.withColumn("_paths", F.expr(_located("_cand", "_cand_rest", f"@match RLIKE {_q(PATH)}", len(KINDS) - 1)))
    cut = "_t"
    for p, n in CUT:
        cut = f"regexp_replace({cut}, {_q(p)}, '{' ' * n}')"
    df = df.withColumn("_cut", F.expr(f"IF(size(_cand) = 0, '', {cut})"))  # as long as the text
    for name, pattern, keep, classes in (
            ("whole", CANDIDATE, _some("@match", [p for p, _ in CLASSES]), CLASSES),
            ("segment", SEGMENT, f"{_some('@match', [p for p, _ in SEGMENT_CLASSES])} AND NOT @match RLIKE {_q(WORDS)}", SEGMENT_CLASSES)):
        df = df.withColumn("_found", F.expr(f"regexp_extract_all(_cut, {_q(pattern)}, 0)"))
        df = df.withColumn("_found_rest", F.expr(f"IF(size(_found) = 0, CAST(array() AS array<string>), split(_cut, {_q(pattern)}, -1))"))
        df = df.withColumn("_runs", F.expr(_located("_found", "_found_rest", keep, len(KINDS) - 1, text=True)))
        df = df.withColumn("_covered", F.expr(_flags("_runs", "_base")))
        # Flags are zipped, not looked up: Spark may put a column's expression in its place, also inside a lambda.
        df = df.withColumn("_runs", F.expr("transform(filter(arrays_zip(_runs, _covered), z -> NOT z._covered), z -> z._runs)"))
        df = df.withColumn("_dense", F.expr(f"transform(_runs, r -> named_struct('run', r, 'd', {_dense('r.m', classes)}))"))
        df = df.withColumn(f"_{name}", F.expr(f"""transform(filter(_dense, x -> x.d.first >= 0), x -> named_struct('run', x.run, 'span', named_struct(
            'start', x.run.start + x.d.first - {WINDOW - 1}, 'ord', {len(KINDS) - 1}, 'stop', x.run.start + x.d.last + 1)))"""))
    df = df.withColumns({f"_{name}_runs": F.expr(f"transform(_{name}, x -> x.run)") for name in ("whole", "segment")})
    df = df.withColumns({"_in_path": F.expr(_flags("_whole_runs", "_paths")), "_split": F.expr(_flags("_whole_runs", "_segment_runs", around=True))})
    path = f"(z._whole.run.m RLIKE {_q(PATH)} OR z._in_path)"
    df = df.withColumn("_whole", F.expr(f"transform(filter(arrays_zip(_whole, _in_path, _split), z -> NOT ({path} AND NOT z._split)), z -> z._whole.span)"))
    df = df.withColumn("_parts", F.expr("transform(_segment, g -> g.span)"))
    df = df.withColumn("_covered", F.expr(_flags("_parts", "_whole")))
    df = df.withColumn("secret_spans", F.expr("array_sort(concat(_base, _whole, transform(filter(arrays_zip(_parts, _covered), z -> NOT z._covered), z -> z._parts)))"))
    return df.drop("_t", "_base", "_paths", "_cut", "_found", "_found_rest", "_runs", "_dense", "_whole", "_segment", "_covered",
                   "_whole_runs", "_segment_runs", "_in_path", "_split", "_parts", *(f"_{k}{s}" for k, _ in kinds for s in ("", "_rest")))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by a mask; overlapping spans
    become one. Texts without spans stay as they are, null stays null."""
    spans = scan(docs)
    # Spans in pieces of about sqrt(n); a piece works on the text from the end of what comes before it to its own end.
    piece = f"""aggregate(sequence(k * w, least(size(secret_spans), (k + 1) * w) - 1),
        named_struct('at', before[k], 'out', CAST(array() AS array<string>)),
        (a, i) -> IF(secret_spans[i].start >= a.at,
            named_struct('at', secret_spans[i].stop, 'out', concat(a.out, array(substring(sub, a.at - before[k] + 1, secret_spans[i].start - a.at), '{MASK}'))),
            named_struct('at', greatest(a.at, secret_spans[i].stop), 'out', a.out)),
        a -> array_join(a.out, ''))"""
    pieces = f"""transform(sequence(0, size(before) - 2), k ->
        transform(array(substring(text, before[k] + 1, before[k + 1] - before[k])), sub -> {piece})[0])"""
    masked = f"""transform(array(CAST(ceil(sqrt(size(secret_spans))) AS int)), w ->
        transform(array({_bases("size(secret_spans)", "0", "secret_spans[i].stop", "greatest(@a, @b)")}), before ->
            concat(array_join({pieces}, ''), substring(text, element_at(before, -1) + 1)))[0])[0]"""
    return spans.withColumn("text", F.expr(f"IF(text IS NULL OR size(secret_spans) = 0, text, {masked})")).drop("secret_spans")


def span_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    shown = f"x -> concat({kinds}[x.ord], ':', x.start, ':', x.stop)"
    return scan(docs.select("doc_id", "text")).select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(secret_spans, x -> x.ord = {i})) AS bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.expr(f"sha2(array_join(transform(filter(secret_spans, x -> x.ord < 3), {shown}), ','), 256)").alias("base_sha256"),
        F.expr(f"array_join(transform(secret_spans, {shown}), ',')").alias("spans"),
    )

"""Chunking and redaction by rules in DataFrame functions: no text leaves the JVM.

Rules whose matches hold no blank, line feed or quote (``RuleDetector.unbroken``) find the same in a whole text as in its chunks, as long as
these end softly, and such a match never reaches over the quotes around a guarded blob. Texts in which a chunk might end hard are chunked first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.kernels import chunk, text

#: Characters without a blank or a line feed from which on a chunk of TARGET bytes could end hard: half of it, in characters of four bytes.
RUN = chunk.TARGET // 8
#: A character's bytes after its first one, read as Latin-1.
INNER = "[\\u0080-\\u00BF]*"
CHUNKS = "array<struct<ord:int,start:int,text:string,hard_left:boolean,hard_right:boolean>>"
_CUTS = "array<struct<start:int,end:int,hard_left:boolean,hard_right:boolean>>"
_CUTTING = f"struct<start:int,hard:boolean,cuts:{_CUTS}>"
_SPAN = "array<struct<start:int,minus_end:int,ord:int,n:int,value:string,class:string>>"
_KEPT = f"struct<end:int,kept:{_SPAN}>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, as a lambda's argument is not put in its place."""
    return F.element_at(F.transform(F.array(value), body), 1)


def may_break(said: Column, target: int = chunk.TARGET) -> Column:
    return (F.octet_length(said) > target) & said.rlike(f"[^ \\n]{{{max(1, target // 8)}}}")


def chunks(said: Column, target: int = chunk.TARGET, overlap: int = chunk.OVERLAP) -> Column:
    """The parts that :func:`cloakwork.kernels.chunk.split` makes: the bytes are read as Latin-1, window by window, so places are bytes."""
    if target < 8:
        raise ValueError("a chunk has room for two characters at least")
    overlap, middle = min(overlap, target // 4), target // 2

    def cut(state: Column, w: Column) -> Column:
        """One more chunk from the window of target + 1 bytes behind the state's start."""
        back = F.reverse(F.substring(w, middle + 1, target - middle))
        line, blank = F.instr(back, "\n"), F.instr(back, " ")
        hard = F.lit(target) - F.length(F.regexp_extract(F.substring(w, target - 2, 4), f"({INNER})\\z", 1))
        soft = (line > 0) | (blank > 0)
        end = F.when(line > 0, F.lit(target + 1) - line).when(blank > 0, F.lit(target + 1) - blank).otherwise(hard)

        def on(end: Column) -> Column:
            again = F.greatest(end - overlap, F.lit(1))
            again = F.least(end, again + F.length(F.regexp_extract(w.substr(again + 1, F.lit(4)), f"^({INNER})", 1)))
            one = F.struct(state["start"].alias("start"), (state["start"] + end).alias("end"), state["hard"].alias("hard_left"), (~soft).alias("hard_right"))
            return F.struct((state["start"] + F.when(soft, end).otherwise(again)).alias("start"), (~soft).alias("hard"), F.concat(state["cuts"], F.array(one)).cast(_CUTS).alias("cuts")).cast(_CUTTING)

        return let(end, on)

    def of(data: Column) -> Column:
        size = F.octet_length(data)
        window = lambda s: F.decode(F.substring(data, s["start"] + 1, F.lit(target + 1)), "ISO-8859-1")
        step = lambda s, _: F.when(size - s["start"] <= target, s).otherwise(let(window(s), lambda w: cut(s, w)))
        nothing = F.struct(F.lit(0).alias("start"), F.lit(False).alias("hard"), F.array().cast(_CUTS).alias("cuts")).cast(_CUTTING)
        done = F.aggregate(F.sequence(F.lit(0), F.floor(size / max(1, middle - overlap)).cast("int") + 1), nothing, step)
        last = lambda s: F.concat(s["cuts"], F.array(F.struct(s["start"].alias("start"), size.alias("end"), s["hard"].alias("hard_left"), F.lit(False).alias("hard_right")))).cast(_CUTS)
        part = lambda c, n: F.struct(n.alias("ord"), c["start"].alias("start"), F.decode(F.substring(data, c["start"] + 1, c["end"] - c["start"]), "UTF-8").alias("text"), c["hard_left"].alias("hard_left"), c["hard_right"].alias("hard_right"))
        return F.transform(let(done, last), part)

    whole = F.array(F.struct(F.lit(0).alias("ord"), F.lit(0).alias("start"), said.alias("text"), F.lit(False).alias("hard_left"), F.lit(False).alias("hard_right")))
    return F.when(F.octet_length(said) <= target, whole.cast(CHUNKS)).when(said.isNotNull(), let(said.cast("binary"), of).cast(CHUNKS))


def _taken(part: Column, n: int, kind: str) -> Callable[[Column, Column], Column]:
    """One more match of rule ``n`` in a chunk behind the ones so far."""

    def step(state: Column, pair: Column) -> Column:
        start = state["end"] + F.octet_length(pair["gap"])
        end = start + F.octet_length(pair["value"])
        cut = (part["hard_right"] & (end == F.octet_length(part["text"]))) | (part["hard_left"] & (start == 0))
        span = F.struct((part["start"] + start).alias("start"), (-part["start"] - end).alias("minus_end"), part["ord"].alias("ord"), F.lit(n).alias("n"), pair["value"].alias("value"), F.lit(kind).alias("class"))
        return F.struct(end.alias("end"), F.when(cut, state["kept"]).otherwise(F.concat(state["kept"], F.array(span)).cast(_SPAN)).alias("kept")).cast(_KEPT)

    return step


def rule_spans(parts: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Every match of every rule in the chunks, by its bytes in the text; a match's place is the pieces and the matches before it. What a hard end cuts is dropped."""
    nothing = F.struct(F.lit(0).alias("end"), F.array().cast(_SPAN).alias("kept")).cast(_KEPT)

    def of(part: Column) -> Column:
        found = []
        for n, (kind, pattern) in enumerate(rules):
            pairs = F.zip_with(F.split(part["text"], pattern, -1), F.regexp_extract_all(part["text"], F.lit(pattern), F.lit(0)), lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
            found.append(F.aggregate(F.filter(pairs, lambda p: p["value"].isNotNull()), nothing, _taken(part, n, kind))["kept"])
        return F.concat(*found)

    return F.flatten(F.transform(parts, of))


def kept_spans(spans: Column) -> Column:
    """Of spans by start, the longer first, those that do not lie inside the last one kept."""

    def step(state: Column, span: Column) -> Column:
        inside = -span["minus_end"] <= state["end"]
        return F.when(inside, state).otherwise(F.struct((-span["minus_end"]).alias("end"), F.concat(state["kept"], F.array(span)).cast(_SPAN).alias("kept")).cast(_KEPT))

    return F.aggregate(F.array_sort(spans), F.struct(F.lit(-1).alias("end"), F.array().cast(_SPAN).alias("kept")).cast(_KEPT), step)["kept"]


def pairs_of(kept: Column, nonce: bytes, hex_digits: int = text.HEX_DIGITS) -> Column:
    """(from, to) of each distinct value of the spans in their order, under the class of the first."""

    def pair(span: Column) -> Column:
        digest = F.sha2(F.concat(F.lit(bytearray(nonce)), F.encode(span["value"], "UTF-8")), 256)
        return F.struct(span["value"].alias("from"), F.concat(F.lit(text.PREFIX), F.upper(span["class"]), F.lit("_"), F.substring(digest, 1, hex_digits)).alias("to"))

    def distinct(spans: Column) -> Column:
        values = F.transform(spans, lambda s: s["value"])
        return let(values, lambda vs: F.transform(F.filter(spans, lambda s, n: F.array_position(vs, s["value"]) == n + 1), pair))

    return let(F.filter(kept, lambda s: F.octet_length(s["value"]) >= text.SPAN_MIN), distinct)


def _replaced(said: Column, old: Column, new: Column, guard: bool) -> Column:
    """Every occurrence of ``old``, which holds no quote, outside of the blobs that are guarded in the text as it stands."""
    plain = F.replace(said, old, new)
    if not guard:
        return plain
    pattern = text.BLOB.pattern.decode()
    quoted = F.regexp_extract_all(said, F.lit(pattern), F.lit(0))
    piece = lambda gap, blob: F.concat(F.replace(gap, old, new), F.when(blob.isNull(), "").when(F.octet_length(blob) >= text.BLOB_MIN + 2, blob).otherwise(F.replace(blob, old, new)))
    return F.when(said.contains('"'), F.array_join(F.zip_with(F.split(said, pattern, -1), quoted, piece), "")).otherwise(plain)


def folded(said: Column, pairs: Column, back: bool = False, guard: bool = True) -> Column:
    """``said`` with all ``pairs`` (from, to) applied one after the other, the longest first; with ``back`` the other way round.

    Null pairs are none. A replaced string with a quote is an error, as it could reach over a guarded blob's end.
    """
    old, new = ("to", "from") if back else ("from", "to")
    numbered = F.transform(pairs, lambda p, n: F.struct((-F.octet_length(p[old])).alias("minus"), n.alias("n"), p[old].alias("old"), p[new].alias("new")))
    sound = F.filter(F.array_sort(numbered), lambda p: p["old"] != "")
    done = F.aggregate(sound, said, lambda so_far, p: F.when(so_far.contains(p["old"]), _replaced(so_far, p["old"], p["new"], guard)).otherwise(so_far))
    odd = F.exists(pairs, lambda p: p[old].contains('"'))
    return F.when(F.coalesce(F.size(pairs), F.lit(0)) <= 0, said).when(odd, F.raise_error(F.lit("a value with a quote cannot be replaced natively"))).otherwise(done)

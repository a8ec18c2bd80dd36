"""Nested JSON records to flat child tables, by Arrow buffers and parent-index kernels.

No record is parsed by itself. The texts of a whole Arrow batch are one byte buffer: quote parity, bracket depth and
container membership come from vectorised scans over it, which also check JSON's grammar. Lists then exist as offsets
into that buffer; members are emitted list level by list level, and the keys (record id, path, positions) reach the
children by `take` with the parent index.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder

#: Up to so many distinct list paths are kept on the driver and sent with the tasks; more are read from a written table.
MAX_SHIPPED_PATHS = 20_000

_STRUCT = np.zeros(256, bool)
_STRUCT[[ord(c) for c in "{}[]:,"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
_ESCAPABLE = np.zeros(256, bool)
_ESCAPABLE[[ord(c) for c in '"\\/bfnrtu']] = True
_SCALAR = r"^(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity)$"


def _spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings buf[start:end], gathered into one new Arrow buffer."""
    n = (end - start).astype(np.int64)
    off = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=off[1:])
    at = np.arange(off[-1], dtype=np.int64) + np.repeat(start - off[:-1], n)
    return pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(off), pa.py_buffer(buf[at].tobytes())])


def _blank(n: int) -> pa.Array:
    return pa.nulls(n, pa.large_string()).fill_null("")


class _Tokens:
    """Tokens of all texts of a batch, with container, element index and key of each; `good` marks readable texts."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        off = off - off[0]
        rows = len(texts)
        good = np.diff(off) > 0
        row_of = lambda at: np.searchsorted(off, at, "right") - 1
        # Escapes: of each run of backslashes inside one row, an odd one escapes the byte after it.
        bs = np.flatnonzero(buf == 92)
        quotes = np.flatnonzero(buf == 34)
        escaped = np.zeros(0, np.int64)
        if len(bs):
            rb = row_of(bs)
            first = np.r_[True, (np.diff(bs) != 1) | (np.diff(rb) != 0)]
            starts = np.flatnonzero(first)
            length = np.diff(np.r_[starts, len(bs)])
            ends = bs[starts] + length
            odd = length % 2 == 1
            escaped = ends[odd]
            over = escaped >= off[rb[starts[odd]] + 1]
            good[rb[starts[odd]][over]] = False
            escaped = escaped[~over]
            wrong = ~_ESCAPABLE[buf[escaped]]
            good[row_of(escaped[wrong])] = False
            for k in range(1, 5):
                u = escaped[buf[escaped] == ord("u")]
                at = np.minimum(u + k, max(len(buf) - 1, 0))
                bad = (u + k >= off[row_of(u) + 1]) | ~_HEX[buf[at]] if len(u) else np.zeros(0, bool)
                good[row_of(u[bad])] = False
            quotes = quotes[~np.isin(quotes, escaped[buf[escaped] == 34])]
        # Inside a string: parity of the quotes so far; an unclosed string ends with its row.
        toggle = np.zeros(len(buf), np.uint8)
        toggle[quotes] = 1
        odd_rows = np.flatnonzero(np.bincount(row_of(quotes), minlength=rows)[:rows] % 2 == 1) if len(quotes) else np.zeros(0, np.int64)
        good[odd_rows] = False
        nxt = off[odd_rows + 1]
        np.bitwise_xor.at(toggle, nxt[nxt < len(buf)], 1)
        inside = np.bitwise_xor.accumulate(toggle).astype(bool) if len(buf) else np.zeros(0, bool)
        good[row_of(np.flatnonzero(inside & (buf < 32)))] = False
        quote = np.zeros(len(buf), bool)
        quote[quotes] = True
        opening = quote & inside
        struct = _STRUCT[buf] & ~inside
        scalar = ~(_STRUCT[buf] | _SPACE[buf] | quote | inside)
        head = scalar.copy()
        if len(buf):
            head[1:] &= ~scalar[:-1]
            at = off[:-1][off[:-1] < len(buf)]
            head[at] |= scalar[at]
        pos = np.flatnonzero(struct | opening | head)
        kind = buf[pos].copy()
        kind[head[pos]] = ord("V")
        kind[opening[pos]] = ord("S")
        row = row_of(pos)
        end = pos + 1
        is_s = kind == ord("S")
        closing = np.flatnonzero(quote & ~inside)
        if len(closing):
            c = np.searchsorted(closing, pos[is_s])
            end[is_s] = np.where(c < len(closing), closing[np.minimum(c, len(closing) - 1)] + 1, pos[is_s] + 1)
        is_v = kind == ord("V")
        tail = scalar.copy()
        if len(buf):
            tail[:-1] &= ~scalar[1:]
            last = (off[1:] - 1)[np.diff(off) > 0]
            tail[last] |= scalar[last]
        end[is_v] = np.flatnonzero(tail)[: is_v.sum()] + 1
        if is_v.any():
            fine = pc.match_substring_regex(_spans(buf, pos[is_v], end[is_v]), _SCALAR).to_numpy(zero_copy_only=False)
            good[row[is_v][~fine]] = False
        # Depth, and from it the container of each token: the last opening of its level before it.
        opens = (kind == ord("{")) | (kind == ord("["))
        closes = (kind == ord("}")) | (kind == ord("]"))
        step = opens.astype(np.int64) - closes
        depth = np.cumsum(step)
        n = len(pos)
        first_tok = np.searchsorted(row, np.arange(rows))
        base = np.where(first_tok > 0, depth[np.maximum(first_tok - 1, 0)], 0) if n else np.zeros(rows, np.int64)
        depth = depth - base[row]
        level = np.where(opens, depth - 1, depth) + closes.astype(np.int64)  # closers count to the level they close
        good[row[depth < 0]] = False
        last_tok = np.searchsorted(row, np.arange(rows), "right") - 1
        has = last_tok >= first_tok
        good &= has
        good[has & (depth[np.maximum(last_tok, 0)] != 0)] = False if n else good[has]
        # A row's start opens its level 0. Records: markers (openers one level down, row starts) and tokens.
        mk = np.flatnonzero(opens)
        m_tok = np.r_[np.full(rows, -1), mk]
        m_row = np.r_[np.arange(rows), row[mk]]
        m_lvl = np.r_[np.zeros(rows, np.int64), level[mk] + 1]
        m_pos = np.r_[off[:-1] * 2 - 1, pos[mk] * 2 + 1]
        lvl = np.r_[m_lvl, level]
        order = np.lexsort((np.r_[m_pos, pos * 2], lvl, np.r_[m_row, row]))
        is_marker = order < len(m_tok)
        marks = np.where(is_marker, np.arange(len(order)), 0)
        owner = np.maximum.accumulate(marks) if len(order) else marks
        owner_marker = order[owner]
        comma = np.zeros(len(order), np.int64)
        tok_of = order - len(m_tok)
        comma[~is_marker] = kind[tok_of[~is_marker]] == ord(",")
        seen = np.cumsum(comma)
        index = seen - seen[owner] if len(order) else seen
        container = np.full(n, -1, np.int64)
        element = np.zeros(n, np.int64)
        container[tok_of[~is_marker]] = m_tok[owner_marker[~is_marker]]
        element[tok_of[~is_marker]] = index[~is_marker]
        ctype = np.where(container >= 0, kind[np.maximum(container, 0)], 0)
        # Grammar: what may stand before each token.
        prev = np.r_[0, kind[:-1]] if n else kind
        prev[first_tok[has]] = 0
        value = opens | is_s | is_v
        in_obj, in_list = ctype == ord("{"), ctype == ord("[")
        after_open_or_comma = (prev == ord(",")) | (prev == ctype)
        key = is_s & in_obj & after_open_or_comma
        prev_key = np.r_[False, key[:-1]] if n else key
        value_end = np.isin(prev, [ord(c) for c in "SV}]"]) & ~prev_key
        ok = np.zeros(n, bool)
        ok |= key
        ok |= value & in_obj & (prev == ord(":"))
        ok |= value & in_list & after_open_or_comma
        ok |= value & (ctype == 0) & (prev == 0)
        ok |= (kind == ord(":")) & in_obj & prev_key
        ok |= (kind == ord(",")) & (in_obj | in_list) & value_end
        ok |= (kind == ord("}")) & in_obj & (value_end | (prev == ord("{")))
        ok |= (kind == ord("]")) & in_list & (value_end | (prev == ord("[")))
        good[row[~ok]] = False
        # An opener's end is its closer's.
        cl = np.flatnonzero(closes)
        okc = container[cl] >= 0
        end[container[cl][okc]] = pos[cl][okc] + 1
        keyed = value & in_obj & ~key
        self.buf, self.pos, self.end, self.kind, self.row, self.level = buf, pos, end, kind, row, level
        self.container, self.element, self.good = container, element, good
        self.value = value & ~key & good[row] if n else value
        self.keyed = keyed
        self.key_tok = np.arange(n) - 2  # of a keyed value: key, colon, value

    def unescape(self, tok: np.ndarray) -> list[str]:
        """Contents of string tokens; those without a backslash are only sliced."""
        out = _spans(self.buf, self.pos[tok], self.end[tok]).to_pylist()
        return [json.loads(x) if "\\" in x else x[1:-1] for x in out]


def _walk(texts: pa.Array, ids: pa.Array, roots: tuple[str, ...] | None, base_path: pa.Array, base_pos: pa.Array, base_owner: pa.Array | None, lists: set[str] | None, values: bool, found: set[str], out: list[pa.Table]) -> None:
    """Emits the list members of `texts`. roots: only these keys of the top object; None: the top is a list at base_path."""
    t = _Tokens(texts)
    n = len(t.pos)
    if not n:
        return
    obj, arr = t.kind == ord("{"), t.kind == ord("[")
    # path and positions of each container, dictionary-coded; filled from level to level
    names: list[str] = [""]
    code_of: dict[str, int] = {"": 0}

    def code(path: str) -> int:
        if path not in code_of:
            code_of[path] = len(names)
            names.append(path)
        return code_of[path]

    path = np.full(n, -1, np.int64)
    owner_path = np.zeros(n, np.int64)  # path of the list whose member encloses the container's content
    at = np.zeros(n, np.int64)  # index into store of position strings
    store: list[pa.Array] = [base_pos]
    size = len(base_pos)

    def add(a: pa.Array) -> int:
        nonlocal size
        store.append(a)
        size += len(a)
        return size - len(a)

    top = np.flatnonzero((t.level == 0) & t.value & (obj if roots is not None else arr))
    if roots is not None:
        path[top] = 0
    else:
        u, inv = np.unique(np.asarray(base_path.to_pylist(), dtype=object), return_inverse=True)
        path[top] = np.array([code(x) for x in u])[inv][t.row[top]]
        owner_path[top] = np.array([code(x) for x in base_owner.to_pylist()], np.int64)[t.row[top]]
    at[top] = t.row[top]
    nested: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    is_null = np.zeros(n, bool)
    v = np.flatnonzero(t.kind == ord("V"))
    is_null[v] = t.buf[t.pos[v]] == ord("n")
    flat = None

    def emit(tok: np.ndarray, pcode: np.ndarray, where: np.ndarray, up_code: np.ndarray, up_where: np.ndarray) -> None:
        if not len(tok):
            return
        cat = pa.chunked_array(flat)
        paths = pa.array(names, pa.large_string())
        cols = {
            "id": ids.take(pa.array(t.row[tok])),
            "child_path": paths.take(pa.array(pcode)),
            "child_pos": cat.take(pa.array(where)),
        }
        if values:
            cols |= {"parent_path": paths.take(pa.array(up_code)), "parent_pos": cat.take(pa.array(up_where)), "value_json": _spans(t.buf, t.pos[tok], t.end[tok])}
        out.append(pa.table(cols))

    for lv in range(1, int(t.level.max(initial=0)) + 2):
        tok = np.flatnonzero((t.level == lv) & t.value & (t.container >= 0))
        if not len(tok):
            break
        tok = tok[path[t.container[tok]] >= 0]
        if not len(tok):
            break
        par = t.container[tok]
        kd = tok[t.keyed[tok]]
        if len(kd):  # values under a key: the last of a repeated key counts
            keys = _spans(t.buf, t.pos[kd - 2] + 1, t.end[kd - 2] - 1).dictionary_encode()
            kc = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            ks = [json.loads(f'"{k}"') if "\\" in k else k for k in keys.dictionary.to_pylist()]
            _, lastpos = np.unique((t.container[kd] * len(ks) + kc)[::-1], return_index=True)
            keep = np.sort(len(kd) - 1 - lastpos)
            kd, kc = kd[keep], kc[keep]
            if lv == 1 and roots is not None:
                keep = np.array([k in roots for k in ks])[kc]
                kd, kc = kd[keep], kc[keep]
            pp = path[t.container[kd]]
            pair, inv = np.unique(pp * len(ks) + kc, return_inverse=True)
            pc_new = np.array([code(f"{names[x // len(ks)]}.{ks[x % len(ks)]}" if names[x // len(ks)] else ks[x % len(ks)]) for x in pair], np.int64)[inv] if len(pair) else np.zeros(0, np.int64)
            path[kd] = pc_new
            at[kd] = at[t.container[kd]]
            owner_path[kd] = owner_path[t.container[kd]]
            # lists given as JSON text
            st = kd[t.kind[kd] == ord("S")]
            if len(st):
                cand = st[(t.end[st] - t.pos[st] >= 4)]
                body = _spans(t.buf, t.pos[cand] + 1, t.end[cand] - 1)
                looks = pc.match_substring_regex(body, r"^(?:\s|\\[nrt])*\[[\s\S]*\](?:\s|\\[nrt])*$").to_numpy(zero_copy_only=False)
                cand = cand[looks]
                if len(cand):
                    inner = _Tokens(pa.array(t.unescape(cand), pa.large_string()))
                    tops = np.flatnonzero((inner.level == 0) & inner.value & (inner.kind == ord("[")))
                    cand = cand[np.unique(inner.row[tops])]
                    if len(cand):
                        nested.append((cand, path[cand].copy(), at[cand].copy(), owner_path[cand].copy()))
                        found.update(names[c] for c in np.unique(path[cand]))
                        path[cand] = -1
            found.update(names[c] for c in np.unique(path[kd[arr[kd]]]) if c >= 0)
            if lists is not None:  # lone values of list fields
                listed = np.array([x in lists for x in names])
                lone = kd[~arr[kd] & ~is_null[kd] & (path[kd] >= 0)]
                lone = lone[listed[path[lone]]]
                if len(lone):
                    flat = store
                    up_at, up_path = at[lone].copy(), owner_path[lone].copy()
                    prior = pa.chunked_array(store).take(pa.array(at[lone])).combine_chunks()
                    new = add(_join(prior, pa.array(np.zeros(len(lone), np.int64))))
                    at[lone] = new + np.arange(len(lone))
                    owner_path[lone] = path[lone]
                    flat = store
                    emit(lone, path[lone], at[lone], up_path, up_at)
        ar = tok[arr[par]]
        if len(ar):
            c = t.container[ar]
            prior = pa.chunked_array(store).take(pa.array(at[c])).combine_chunks()
            new = add(_join(prior, pa.array(t.element[ar])))
            path[ar] = path[c]
            up_at, up_path = at[c], owner_path[c]
            at[ar] = new + np.arange(len(ar))
            owner_path[ar] = path[c]
            if lists is not None:
                flat = store
                k = ~is_null[ar] & ~arr[ar]
                emit(ar[k], path[ar][k], at[ar][k], up_path[k], up_at[k])
    for cand, pcode, where, up in nested:
        cat = pa.chunked_array(store)
        _walk(pa.array(t.unescape(cand), pa.large_string()), ids.take(pa.array(t.row[cand])), None, pa.array([names[c] for c in pcode], pa.large_string()), cat.take(pa.array(where)).combine_chunks(), pa.array([names[c] for c in up], pa.large_string()), lists, values, found, out)


def _join(prior: pa.Array, index: pa.Array) -> pa.Array:
    """`prior/index`, or `index` alone under the root."""
    index = index.cast(pa.large_string())
    return pc.if_else(pc.equal(prior, ""), index, pc.binary_join_element_wise(prior, index, pa.scalar("/", pa.large_string())))


def _batches(batch: pa.RecordBatch, most: int = 6_000_000) -> Iterator[pa.Table]:
    """The non-null rows of `batch`, in slices of at most about `most` bytes of text."""
    t = pa.table({"id": batch.column(0), "text": batch.column(1).cast(pa.large_string())})
    t = t.filter(pc.is_valid(t["text"])).combine_chunks()
    if not t.num_rows:
        return
    ends = np.cumsum(pc.binary_length(t["text"]).to_numpy())
    part = ends // most
    for p in np.unique(part):
        i = np.flatnonzero(part == p)
        yield t.slice(i[0], len(i))


def list_paths(df: DataFrame, text: str | Column, roots: tuple[str, ...]) -> DataFrame:
    """Distinct dotted paths below `roots` at which some record has a list (also one given as JSON text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[str] = set()
        for b in it:
            for t in _batches(b):
                _walk(t["text"].combine_chunks(), t["id"].combine_chunks(), roots, _blank(0), _blank(t.num_rows), None, None, False, found, [])
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["path"])

    col = F.col(text) if isinstance(text, str) else text
    return df.select(F.lit(0).cast("long").alias("id"), col.alias("text")).mapInArrow(run, "path string").distinct()


def flatten_lists(df: DataFrame, key: str, text: str, roots: tuple[str, ...], values: bool = True) -> DataFrame:
    """One row per list member below `roots` of the JSON object in column `text`.

    Result: `key`, child_path, child_pos, and with `values` also parent_path, parent_pos (the enclosing list member;
    empty at the top) and value_json (the member's text). A lone value where some other record has a list counts as a
    list of one; a list given as JSON text is that list; null members keep their position but give no row.

    Null, empty or unreadable texts, and texts whose top is no object, give no rows; an empty table gives an empty one.
    Null keys are kept. Repeated rows are flattened each by itself. Other columns are ignored, whatever their names.
    Of a repeated object key the last counts. Texts of any length are read whole.
    """
    spark = df.sparkSession
    found = list_paths(df, text, roots)
    head = [r[0] for r in found.limit(MAX_SHIPPED_PATHS + 1).collect()]
    where, known = None, frozenset(head)
    if len(head) > MAX_SHIPPED_PATHS:  # as many as records can make: the tasks look up their own
        where = shared_folder(spark, "list-paths")
        found.write.parquet(where)
    key_type = df.schema[key].dataType
    fields = [T.StructField(key, key_type), T.StructField("child_path", T.StringType()), T.StructField("child_pos", T.StringType())]
    if values:
        fields += [T.StructField(c, T.StringType()) for c in ("parent_path", "parent_pos", "value_json")]
    schema = T.StructType(fields)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for t in _batches(b):
                texts, ids = t["text"].combine_chunks(), t["id"].combine_chunks()
                lists = known
                if where:
                    lists = _own_paths(where, texts, ids, roots)
                out: list[pa.Table] = []
                _walk(texts, ids, roots, _blank(0), _blank(len(texts)), None, lists, values, set(), out)
                for o in out:
                    arrays = [o.column(0)] + [c.cast(pa.string()) for c in o.columns[1:]]
                    yield from pa.table(arrays, names=[f.name for f in fields]).combine_chunks().to_batches(max_chunksize=20_000)

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)


class _Asked(set):
    """Stands for the set of list paths and notes what is looked up in it."""

    def __contains__(self, path: object) -> bool:
        self.add(path)
        return False


def _own_paths(where: str, texts: pa.Array, ids: pa.Array, roots: tuple[str, ...]) -> set[str]:
    """Of the written list paths those that the walk meets in this batch, read part by part."""
    import pyarrow.dataset as ds
    from pyarrow.fs import FileSystem

    asked = _Asked()
    _walk(texts, ids, roots, _blank(0), _blank(len(texts)), None, asked, False, set(), [])
    fs, path = FileSystem.from_uri(where if "://" in where or where.startswith("file:") else f"file://{where}")
    met, own = set(asked), set()
    for b in ds.dataset(path, filesystem=fs, format="parquet").to_batches():
        own |= met.intersection(b.column(0).to_pylist())
    return own

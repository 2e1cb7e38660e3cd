"""SentencePiece encoding and decoding of merge-type models with a table of each prefix's last token."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import with_columns

SPACE = "▁"
#: The last token of a prefix that ends in a character without one.
NO_TOKEN = -1
#: A worker keeps the ids of pre-tokens, and of words, of so many characters at most, and so many of either, a text's more at most; so many answers of the pair test, and steps of the automaton.
KEPT_CHARS, KEPT_WORDS, KEPT_PAIRS, KEPT_STEPS = 32, 300_000, 1_000_000, 1_000_000
#: Keys of a state's entries beside its characters.
OUT, FAIL = 0, 1


@dataclass
class Vocabulary:
    """What encoding and decoding need of a model; its size is the vocabulary's, so it can be sent to every task."""

    surface: list[bytes]  # by id, what decoding puts there; nothing for control tokens
    opens: list[bool]  # by id, whether it starts with the space that stands in front of a text
    is_byte: list[bool]
    control: frozenset[int]
    tokens: dict[str, int]  # tokens that merging can give, with plain spaces
    place: dict[int, int]  # of a token's merge in the order of scores; characters come before all
    parts: dict[int, tuple[int, int]]  # the two tokens whose merge makes a token
    tied: frozenset[int]  # tokens that share their place with another one
    ordered: bool  # every token that isn't tied comes after its parts
    bytes_of: list[int]  # ids of the 256 bytes
    end: int


def merged(symbols: list[str], score: Callable[[str], float | None]) -> list[tuple[str, tuple[str, str] | None]]:
    """Plain merging of neighbours, the best-scored first and the left one among equals; each result with its last two parts."""
    now: list[tuple[str, tuple[str, str] | None]] = [(s, None) for s in symbols]
    while True:
        found = [(-s, i) for i in range(len(now) - 1) if (s := score(now[i][0] + now[i + 1][0])) is not None]
        if not found:
            return now
        at = min(found)[1]
        a, b = now[at][0], now[at + 1][0]
        now[at : at + 2] = [(a + b, (a, b))]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Reads a model. One that isn't of merge type with byte fallback, changes texts first, or joins words is an error."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    name = [model.id_to_piece(i) for i in ids]
    plain = [i for i in ids if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
    byte = {int(name[i][3:5], 16): i for i in ids if model.is_byte(i)}
    odd = " ﬁ Å  x "
    if len(byte) != 256 or model.decode(model.encode(odd)) != odd or model.encode("") or not model.encode("a", out_type=str)[0].startswith(SPACE):
        raise ValueError("the model has no byte fallback, or changes texts before it encodes them")
    if any(a != SPACE and b == SPACE for i in plain for a, b in zip(name[i], name[i][1:])):
        raise ValueError("the model has tokens that go on over a space")
    score, of = {name[i]: model.get_score(i) for i in plain}, {name[i]: i for i in plain}
    order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
    tokens, place, parts, sharing = {}, {}, {}, {}
    for i in plain:
        result = merged(list(name[i]), score.get)
        if len(result) > 1:
            continue  # merging never gives this one
        tokens[name[i].replace(SPACE, " ")] = i
        place[i] = -1 if len(name[i]) == 1 else order[score[name[i]]]
        if result[0][1]:
            parts[i] = tuple(of[p] for p in result[0][1])
            sharing.setdefault(place[i], []).append(i)
    tied = frozenset(i for same in sharing.values() if len(same) > 1 for i in same)
    ordered = all(place[i] > max(place[a], place[b]) for i, (a, b) in parts.items() if i not in tied)
    kind = lambda i: b"" if model.is_control(i) else bytes([int(name[i][3:5], 16)]) if model.is_byte(i) else " ⁇ ".encode() if model.is_unknown(i) else name[i].replace(SPACE, " ").encode()
    return Vocabulary(
        [kind(i) for i in ids], [name[i].startswith(SPACE) for i in ids], [model.is_byte(i) for i in ids], frozenset(i for i in ids if model.is_control(i)),
        tokens, place, parts, tied, ordered, [byte[b] for b in range(256)], model.eos_id(),
    )


class PrefixTable:
    """Encodes one pre-token after another.

    Of every prefix only the last token of its encoding is stored. It is the one token that ends there and goes
    with the last token of the prefix before it, so a text is encoded by one pass of the automaton and read off backwards.
    Two neighbours go together if merging their letters gives just them: a merge over their border would have to come first.
    """

    def __init__(self, words: Vocabulary):
        self.words, self.known, self.spaced, self.n_pairs, self.n_steps = words, {}, {}, 0, 0
        self.length = {i: len(t) for t, i in words.tokens.items()}
        self.text = {i: t for t, i in words.tokens.items()}
        self.fits: dict[int, dict[int, bool]] = {i: {NO_TOKEN: True} for i in self.text}
        self.root = self.automaton()
        # No token goes on over a border before spaces, around a character without a token, and between a letter and signs that follow none in any token.
        odd = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in words.tokens) or "\\Z"
        after = {b for t in words.tokens for a, b in zip(t, t[1:]) if re.match(r"[^\W\d_]", a)}
        free = "".join(re.escape(c) for c in ".,;:!?)\"" if c not in after) or "\\Z"
        self.split = re.compile(f" *[^\\W\\d_]+(?=[{free}])| *[^ {odd}]+| +|[{odd}]+").findall

    def automaton(self) -> dict:
        """Start of an automaton over the tokens. A state has the next states by character, under ``OUT`` the tokens that end in it, longest first, and under ``FAIL`` the state of its longest suffix."""
        root: dict = {OUT: (), FAIL: None}
        for t, i in self.words.tokens.items():
            state = root
            for c in t:
                state = state.setdefault(c, {OUT: (), FAIL: None})
            state[OUT] = ((len(t), i, self.fits[i]),)
        level = [(c, s, root) for c, s in root.items() if isinstance(c, str)]
        while level:
            below = []
            for c, state, parent in level:
                back = parent[FAIL]
                while back is not None and c not in back:
                    back = back[FAIL]
                state[FAIL] = root if back is None else back[c]
                state[OUT] += state[FAIL][OUT]
                below += [(k, s, state) for k, s in state.items() if isinstance(k, str)]
            level = below
        return root

    def step(self, state: dict, c: str) -> dict:
        """The next state where ``state`` has none of its own; it is remembered, within a bound."""
        back = state[FAIL]
        while back is not None and c not in back:
            back = back[FAIL]
        found = self.root if back is None else back[c]
        if self.n_steps < KEPT_STEPS:
            self.n_steps += 1
            state[c] = found
        return found

    def plain(self, text: str) -> list[int]:
        """Ids by plain merging, for pairs whose order of merges isn't that of scores alone."""
        of, place = self.words.tokens, self.words.place
        score = lambda t: -place[of[t]] if t in of else None
        return [of[t] for t, _ in merged(list(text), score)]

    def together(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` are what merging makes of their letters.

        Merges are undone from the last one on. While the parts that touch at the border are ``x`` and ``y``,
        their own merge must not come before the one that ends them; a merge on the left goes first among equals.
        """
        w = self.words
        if not w.ordered or (a in w.tied and b in w.tied):
            return self.plain(self.text[a] + self.text[b]) == [a, b]
        x, y, ends, equal_wins = a, b, None, False
        while True:
            both = w.tokens.get(self.text[x] + self.text[y])
            if both is not None and (ends is None or w.place[both] < ends or (equal_wins and w.place[both] == ends)):
                return False
            px, py = w.place[x], w.place[y]
            if px < 0 and py < 0:
                return True
            if px > py:
                ends, equal_wins, x = px, False, w.parts[x][1]
            else:
                ends, equal_wins, y = py, True, w.parts[y][0]

    def last_tokens(self, text: str) -> list[int]:
        """By length of the prefix, the last token of its encoding."""
        last, state, step = [NO_TOKEN], self.root, self.step
        for c in text:
            state = state.get(c) or step(state, c)
            for size, token, fits in state[OUT]:
                before = last[-size]
                fit = fits.get(before)
                if fit is None:
                    fit = fits[before] = self.together(before, token)
                    self.n_pairs += 1
                if fit:
                    last.append(token)
                    break
            else:
                last.append(NO_TOKEN)
        if self.n_pairs > KEPT_PAIRS:
            self.n_pairs = 0
            for fits in self.fits.values():
                fits.clear()
                fits[NO_TOKEN] = True
        return last

    def ids(self, text: str) -> list[int]:
        """Ids of a text with its leading space; a character without a token gives its bytes."""
        last, out, at = self.last_tokens(text), [], len(text)
        while at:
            token = last[at]
            if token == NO_TOKEN:
                out += [self.words.bytes_of[b] for b in reversed(text[at - 1].encode())]
                at -= 1
            else:
                out.append(token)
                at -= self.length[token]
        return out[::-1]

    def packed(self, text: str) -> bytes:
        """Ids of a text with its leading space as 32-bit numbers, put together from those of its pre-tokens."""
        out, known = [], self.known
        for word in self.split(text):
            found = known.get(word)
            if found is None:
                found = array("i", self.ids(word)).tobytes()
                if len(word) <= KEPT_CHARS:
                    known[word] = found
            out.append(found)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, with the space that the model puts in front; nothing for null and empty texts."""
        if not text:
            return b""
        text = " " + text.replace(SPACE, " ")
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        if "  " in text:
            return self.packed(text)
        words = text[1:].split(" ")
        found = list(map(self.spaced.get, words))
        if None in found:
            if len(self.spaced) > KEPT_WORDS:
                self.spaced.clear()
            for i, word in enumerate(words):
                if found[i] is None:
                    found[i] = self.packed(" " + word)
                    if len(word) < KEPT_CHARS:
                        self.spaced[word] = found[i]
        return b"".join(found)


_last: list[PrefixTable] = []


def table_of(words: Vocabulary) -> PrefixTable:
    """The table of a sent vocabulary, built once in a worker while it asks for the same one."""
    if not _last or _last[0].words is not words:
        _last[:] = [PrefixTable(words)]
    return _last[0]


def id_lists(packed: list[bytes]) -> pa.ListArray:
    sizes = np.array([len(p) // 4 for p in packed], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))]))


def encode_texts(docs: DataFrame, path: str, *, keep: list[str], text_col: str = "text", end: bool = True) -> DataFrame:
    """The columns ``keep`` with ``_ids array<int>``, the ids of each whole text, with the end id after them if ``end``.

    Null and empty texts have no ids but that. Nothing is shuffled; the vocabulary is read on the driver and
    sent to the tasks. A text is encoded by pre-tokens of any length; each worker keeps a bounded number of short ones.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    rows = docs.select(*[docs[c].alias(f"_in_{c}") for c in keep], docs[text_col].alias("_text"))

    def make(batch: pa.RecordBatch) -> list:
        table = table_of(sent.value)
        tail = array("i", [table.words.end]).tobytes() if end else b""
        return [id_lists([table.encode(t) + tail for t in batch.column("_text").to_pylist()])]

    found = with_columns(rows, make, "_ids array<int>", drop=("_text",))
    return found.select(*[found[f"_in_{c}"].alias(c) for c in keep], "_ids")


def decoded(words: Vocabulary, ids: list[int]) -> str:
    """The text of one list: spaces for their signs, none for the one in front, and a replacement sign for each byte that is part of no character."""
    out, held, opening = [], b"", True
    for i in [*ids, None]:
        if i is not None and words.is_byte[i]:
            held += words.surface[i]
            opening = False
            continue
        if held:
            out.append(characters(held))
            held = b""
        if i is None or i in words.control:
            continue
        piece = words.surface[i].decode()
        out.append(piece[1:] if opening and words.opens[i] else piece)
        opening = False
    return "".join(out)


def characters(data: bytes) -> str:
    """UTF-8 read character by character; each byte at which none starts becomes a replacement sign."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def decode_lists(words: Vocabulary, surface: pa.Array, opens: np.ndarray, lists: pa.ListArray) -> list[str]:
    """Texts of lists of ids, none null; a whole batch is joined at once unless a list needs ``decoded``: one with a control token in front, or bytes that are no characters."""
    ids, offsets = lists.values, lists.offsets.to_numpy()
    flat = ids.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] if len(lists) else np.zeros(0, np.int32)
    offsets = offsets - offsets[0] if len(lists) else offsets
    sizes = np.diff(offsets)
    starts = offsets[:-1][sizes > 0]
    headed = (np.isin(flat[starts], list(words.control)) & (sizes[sizes > 0] > 1)).any()
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), surface.take(pa.array(flat))), b"")
    try:
        texts = None if headed else joined.cast(pa.string()).to_pylist()
    except pa.ArrowInvalid:  # bytes that are no characters
        texts = None
    if texts is None:
        return [decoded(words, x) for x in lists.to_pylist()]
    strip = np.zeros(len(texts), bool)
    strip[sizes > 0] = opens[flat[starts]]
    return [t[1:] if s else t for t, s in zip(texts, strip)]


def decode_ids(rows: DataFrame, path: str, *, ids_col: str = "_ids", name: str = "_decoded") -> DataFrame:
    """``rows`` with the text of their ids in ``name``; null for null, and for lists that hold a null or what is no id."""
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary(path))

    def make(batch: pa.RecordBatch) -> list:
        words, lists = sent.value, batch.column(ids_col)
        good = lambda x: x is not None and all(i is not None and 0 <= i < len(words.surface) for i in x)
        values = lists.values
        if lists.null_count or values.null_count or (len(values) and not 0 <= pc.min(values).as_py() <= pc.max(values).as_py() < len(words.surface)):
            return [[decoded(words, x) if good(x) else None for x in lists.to_pylist()]]
        return [decode_lists(words, pa.array(words.surface, pa.binary()), np.array(words.opens), lists)]

    return with_columns(rows, make, f"{name} string")

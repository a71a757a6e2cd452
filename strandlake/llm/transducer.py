"""Byte-level BPE as a transducer that is made deterministic as far as texts need it, and a streaming decoder.

Merges are given by ranks alone: two neighbours are joined if their bytes together are a token, the lowest rank first. Undoing a token's
last merge gives its halves, and two neighbouring tokens are compatible if no merge would have crossed their
border. A sequence is what the merges give if and only if all its neighbours are compatible, and each prefix of a word has
one such sequence. So the nondeterministic transducer is small: a state is the last token and a place in
the trie of tokens; a byte leads one step down the trie, and at a token that is compatible with the last one the
transducer may emit it and go back to the trie's root.

A deterministic state is the set of those states that the bytes so far allow, each with the tokens it would still have to emit.
What all of them have in common is emitted at once; they part again within the length of the longest token, which bounds the
lookahead and the set. States are made when a text first reaches them. At STATES transitions a task forgets them all and begins anew,
so memory is bounded; a word of any length takes one step a byte.

Decoding takes tokens as they come: their bytes are hashed or written at once, and a state machine over the last bytes
tells which of them belong to a character that is not yet complete; only those are held back.

Defined results: a match of the pattern that is a token as a whole is that token; null and empty texts have no tokens; there are no
special tokens; repeated documents and rows with a null doc_id have results row by row; there are no ties, as ranks differ; extra columns are ignored; an
empty table gives no rows; doc_id may have any type. A text is encoded whole in one task, with some 200 bytes of memory for each of its words.
The file of ranks is a parameter and is read on the driver; tasks get it as a broadcast.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Transitions that a worker makes before it forgets them; words whose tokens it remembers, as often again for the time before.
STATES, REMEMBERED, PAIRS = 800_000, 300_000, 250_000
#: Tokens that the decoder takes at a time.
CHUNK = 4096


class Ranks:
    """Tokens by rank, the halves that merges make each of, and which neighbours merges leave apart."""

    def __init__(self, rank: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in rank]
        if missing:
            raise ValueError(f"bytes without a rank: {missing[:5]}")
        self.rank = rank
        self.text = {i: t for t, i in rank.items()}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._apart: dict[tuple[int, int], bool] = {}

    @classmethod
    def parsed(cls, lines: bytes) -> Ranks:
        """From lines of a token in base64 and its rank."""
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())})

    def halves(self, token: int) -> tuple[int, int] | None:
        """What the token's last merge joined; None for a byte and for tokens that merges never make."""
        if token not in self._halves:
            whole = self.text[token]
            parts = [whole[k : k + 1] for k in range(len(whole))]
            while len(parts) > 2:
                ranks = [self.rank.get(x + y, token) for x, y in zip(parts, parts[1:])]
                least = min(ranks)
                if least >= token:
                    break
                k = ranks.index(least)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self._halves[token] = (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def apart(self, a: int, b: int) -> bool:
        """Whether merges leave the border between two tokens alone.

        The tokens at the border are taken back one merge at a time, the later merge first. A pair that could have been joined
        before the merge that was taken back last would have been.
        """
        found = self._apart.get((a, b))
        if found is None:
            x, y, before, found = a, b, 1 << 62, True
            while True:
                joined = self.rank.get(self.text[x] + self.text[y])
                if joined is not None and joined < before and self.halves(joined) == (x, y):
                    found = False
                    break
                left, right = self.halves(x), self.halves(y)
                if left is None and right is None:
                    break
                if right is None or (left is not None and x > y):
                    # of equal ranks the left merge comes first, so a pair of this rank is joined before the right one only
                    before, x = x, left[1]
                else:
                    before, y = y + 1, right[0]
            if len(self._apart) >= PAIRS:
                self._apart.clear()
            self._apart[a, b] = found
        return found


class _State(dict):
    """Byte to (next state, tokens emitted). last: the token emitted last, or -1; ways: (tokens to emit, place in the trie), the root last."""

    __slots__ = ("end", "last", "machine", "ways")

    def __init__(self, machine: Transducer, last: int, ways: tuple):
        self.machine, self.last, self.ways = machine, last, ways
        #: What is still to be emitted if the word ends here.
        self.end = ways[-1][0]

    def __missing__(self, byte: int) -> tuple[_State, tuple[int, ...]]:
        step = self[byte] = self.machine.step(self, byte)
        return step


class Transducer:
    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        #: The trie of tokens: for each place the places below by byte (none: no longer token), and its token. Place 0 is the root.
        self.below: list[dict[int, int] | None] = [{}]
        self.token: list[int | None] = [None]
        for text, i in ranks.rank.items():
            # merges never make such a token, so it is not emitted within a word
            if len(text) > 1 and ranks.halves(i) is None:
                continue
            place = 0
            for b in text:
                if self.below[place] is None:
                    self.below[place] = {}
                down = self.below[place].get(b)
                if down is None:
                    down = self.below[place][b] = len(self.token)
                    self.below.append(None)
                    self.token.append(None)
                place = down
            self.token[place] = i
        self.begin_anew()

    def begin_anew(self) -> None:
        self.made, self.states = 0, {}
        self.start = self._state(-1, (((), 0),))

    def _state(self, last: int, ways: tuple) -> _State:
        found = self.states.get((last, ways))
        if found is None:
            found = self.states[last, ways] = _State(self, last, ways)
        return found

    def step(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        self.made += 1
        below, token_of, known = self.below, self.token, self.ranks._apart
        ways, whole = [], None
        for owed, place in state.ways:
            place = below[place].get(byte)
            if place is None:
                continue
            if whole is None:
                token = token_of[place]
                if token is not None:
                    last = owed[-1] if owed else state.last
                    if last < 0:
                        whole = (token,)
                    else:
                        apart = known.get((last, token))
                        if self.ranks.apart(last, token) if apart is None else apart:
                            whole = (*owed, token)
            if below[place] is not None:
                ways.append((owed, place))
        common = len(whole)
        for owed, _ in ways:
            if len(owed) < common:
                common = len(owed)
            while owed[:common] != whole[:common]:
                common -= 1
            if not common:
                break
        if not common:
            # what was emitted last no longer matters if each way has a token to emit
            last = state.last if any(not owed for owed, _ in ways) else -2
            return self._state(last, (*ways, (whole, 0))), ()
        ways.append((whole, 0))
        ways = tuple([(owed[common:], place) for owed, place in ways])
        return self._state(whole[common - 1], ways), whole[:common]

    def tokens(self, word: bytes) -> list[int]:
        if self.made > STATES:
            self.begin_anew()
        state, out = self.start, []
        for k, byte in enumerate(word):
            state, found = state[byte]
            if found:
                out += found
            if not k & 0xFFFFF and self.made > STATES:  # within a very long word the states at hand stay
                self.begin_anew()
                state = self._state(state.last, state.ways)
        out += state.end
        return out


class Encoder:
    """Texts to token ids."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.matches, self.machine = ranks, regex.compile(pattern).findall, Transducer(ranks)
        self.known: dict[str, tuple[int, ...]] = {}
        self.earlier: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        found = self.earlier.get(word)
        if found is None:
            data = word.encode()
            whole = self.ranks.rank.get(data)
            found = tuple(self.machine.tokens(data)) if whole is None else (whole,)
        if len(word) < 64:
            if len(self.known) >= REMEMBERED:
                self.earlier, self.known = self.known, {}
            self.known[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for word in self.matches(text):
            ids = known.get(word)
            if ids is None:
                ids = self.word(word)
                known = self.known
            out += ids
        return out


#: Fixed values of UTF-8: for ranges of lead bytes the bytes that follow, and the range of the first of them; the others are 80-BF.
LEADS = [(0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF),
         (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F)]
_LEAD = {b: rest for low, high, *rest in LEADS for b in range(low, high + 1)}


class Utf8:
    """Bytes in pieces to text in pieces; a character whose bytes are not all there is held back."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def open_tail(data: bytes) -> int:
        """How many of the last bytes begin a character that more bytes may complete."""
        for n in range(1, min(3, len(data)) + 1):
            lead = _LEAD.get(data[-n])
            if lead is not None:
                needed, low, high = lead
                for b in data[len(data) - n + 1 :]:
                    if not low <= b <= high:
                        return 0
                    needed, low, high = needed - 1, 0x80, 0xBF
                return n if needed else 0
            if not 0x80 <= data[-n] <= 0xBF:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        n = self.open_tail(data)
        self.held = data[len(data) - n :]
        return data[: len(data) - n].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


class Decoder:
    def __init__(self, ranks: Ranks):
        self.text = ranks.text

    def pieces(self, ids: list[int]):
        """The tokens' bytes, some thousand tokens at a time."""
        for k in range(0, len(ids), CHUNK):
            yield b"".join(map(self.text.__getitem__, ids[k : k + CHUNK]))


_made: dict[tuple[str, str], tuple[Encoder, Decoder, dict[int, str]]] = {}


def _tools(lines: bytes, pattern: str) -> tuple[Encoder, Decoder, dict[int, str]]:
    """One encoder a worker process, file and pattern."""
    key = hashlib.sha256(lines).hexdigest(), pattern
    if key not in _made:
        ranks = Ranks.parsed(lines)
        _made[key] = Encoder(ranks, pattern), Decoder(ranks), {i: str(i) for i in ranks.text}
    return _made[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _mapped(docs: DataFrame, path: str, pattern: str, kinds: dict[str, str], of_row) -> DataFrame:
    """doc_id and the columns that of_row(encoder, decoder, decimal, value) gives for each row's second column."""
    shared = docs.sparkSession.sparkContext.broadcast(_read(path))  # one vocabulary file
    types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}

    def run(batches):
        tools = None
        for b in batches:
            tools = tools or _tools(shared.value, pattern)
            for part in pieces([b]) if "text" in b.schema.names else [b]:
                rows = [of_row(*tools, x) for x in part.column(1).to_pylist()]
                columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, types[t]) for c, t in zip(columns, kinds.values(), strict=True)]], names=["doc_id", *kinds])

    schema = ", ".join(f"{k} {v}" for k, v in {"doc_id": docs.schema["doc_id"].dataType.simpleString(), **kinds}.items())
    return docs.mapInArrow(run, schema)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids of each row."""
    return _mapped(docs.select("doc_id", F.col("text").cast("string").alias("text")), path, pattern, {"ids": "array<int>"}, lambda e, d, names, text: (e.encode(text or ""),))


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """rows: (doc_id, ids). doc_id and text; bytes that are no UTF-8 become replacement characters. Null ids are none."""

    def text_of(e, d, names, ids):
        machine = Utf8()
        parts = [machine.feed(x) for x in d.pieces(ids or [])]
        return ("".join([*parts, machine.finish()]),)

    return _mapped(rows.select("doc_id", "ids"), path, pattern, {"text": "string"}, text_of)


def report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the bytes that they decode to."""

    def of_row(e, d, names, text):
        ids, digest = e.encode(text or ""), hashlib.sha256()
        for x in d.pieces(ids):
            digest.update(x)
        return len(ids), hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest(), digest.hexdigest()

    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return _mapped(docs.select("doc_id", F.col("text").cast("string").alias("text")), path, pattern, kinds, of_row)

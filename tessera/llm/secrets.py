"""Secrets in texts, tagged by a linear-chain conditional random field.

Tokens are runs of letters, digits and ``_-+/.~``; every other printing character is a token by
itself. Each token is tagged as the begin of a secret, inside one or outside. Its features are its
shape (kinds of characters and length; how often letters and digits alternate and capitals follow small letters), its first bytes,
itself, the three tokens before and the one after it, and the document's shares of digits and of
signs together with the shape. The field is trained on generated lines: assignments, headers,
provider keys, web tokens, key files and addresses with passwords, among prose, code, hashes,
identifiers, dates, numbers and addresses that are no secrets. The best tags are found by Viterbi.

Only tokens that no neighbour could turn into a secret are left out of the dynamic programme: where
"outside" leads by more than transitions can make up, every best path has "outside" there, so that
the chain falls into short stretches. The result is that of the whole chain.

Defined results: null and empty texts have no secrets; repeated rows are tagged alike, each for
itself; a row with a null id is reported with a null id; an empty table gives no rows; other columns
are not read (``redacted`` keeps them). Places count characters; a full stop at the end of a secret
isn't part of it.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.tables import batched, table
from tessera.llm.words import chunked, hash_runs

O, B, I = range(3)  # noqa: E741
BUCKETS = 1 << 16
#: Hashed features of fewer tokens of the generated lines get no weight.
LEAST = 4
MASK = "<SECRET>"
_LENGTHS = np.array([2, 3, 5, 8, 12, 16, 20, 28, 40])
_L = len(_LENGTHS) + 1
_RUN = np.zeros(256, bool)
_RUN[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_-+/.~")] = True
_RUN[128:] = True
_KINDS = np.zeros((5, 256), np.int64)  # lower, upper, digit, joining sign, not ASCII
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"_-+/.~", bytes(range(128, 256)))):
    _KINDS[_k, list(_chars)] = 1
_HEX = np.zeros(256, np.int64)
_HEX[list(b"0123456789abcdefABCDEF")] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# where the tables of the features begin
_SHAPE, _MIX, _FILE = 0, 32 * _L, 32 * _L + 4 * 8 * _L
_HASHED = _FILE + 4 * 4 * 3 * 5
SIZE = _HASHED + 6 * BUCKETS


@dataclass
class Tokens:
    """``first[i]:first[i + 1]`` are the tokens of text ``i``; start and end are bytes in ``data``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    features: np.ndarray


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    data, offsets = data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)
    run, sign = _RUN[data], ~_RUN[data] & (data > 32)
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = run[:-1], run[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start, end = np.flatnonzero((run & ~before) | sign), np.flatnonzero((run & ~after) | sign) + 1
    first = np.searchsorted(start, offsets).astype(np.int64)
    n, length = len(start), end - start
    lower = _LOWER[data]
    word, head = hash_runs(lower, start, end, run | sign), hash_runs(data, start, np.minimum(end, start + 4), run | sign)

    def count(per_byte: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(per_byte, out=total[1:], dtype=np.int32)
        return total[end] - total[start]

    kinds = [count(k[data].astype(np.int32)) for k in _KINDS]
    letter = (_KINDS[0] + _KINDS[1])[data]
    change = np.zeros(len(data), np.int32)
    if len(data):
        change[:-1] = (letter[:-1] & _KINDS[2][data[1:]]) | (_KINDS[2][data[:-1]] & letter[1:]) | (_KINDS[0][data[:-1]] & _KINDS[1][data[1:]])
    turns = np.minimum(count(change), 7) if n else length
    size = np.searchsorted(_LENGTHS, length, "right")
    shape = sum((k > 0).astype(np.int64) << b for b, k in enumerate(kinds))
    kind = np.where(kinds[2] == length, 0, np.where(count(_HEX[data].astype(np.int32)) == length, 1, np.where(kinds[0] + kinds[1] + kinds[4] == length, 2, 3)))
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    bytes_of = np.maximum(np.diff(offsets), 1)
    per_text = lambda x: np.bincount(owner, x, len(first) - 1)
    digits = np.searchsorted([0.01, 0.05, 0.2], per_text(kinds[2]) / bytes_of)
    signs = np.searchsorted([0.1, 0.25, 0.45], per_text(sign[start].astype(float)) / np.maximum(np.diff(first), 1))
    coarse = np.where(sign[start] if n else False, 4, np.where(turns > 3, 3, np.where(turns > 0, 2, np.where(kinds[2] > 0, 1, 0))))
    long = np.searchsorted([8, 16], length, "right")
    table_ = [_SHAPE + shape * _L + size, _MIX + (kind * 8 + turns) * _L + size, _FILE + ((digits[owner] * 4 + signs[owner]) * 3 + long) * 5 + coarse]

    def near(step: int) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        if step < 0:
            out[-step:] = word[:step]
        else:
            out[:-step] = word[step:]
        at = np.arange(n) + step
        out[(at < first[owner]) | (at >= first[owner + 1])] = 0
        return out

    for k, hashes in enumerate((head, word, *((near(s) for s in (-1, -2, -3, 1)) if n else ()))):
        table_.append((_HASHED + k * BUCKETS + (hashes >> np.uint64(48)).astype(np.int64)) | ((hashes & np.uint64(0xFFFF)).astype(np.int64) << 32))
    return Tokens(data, start, end, first, np.stack(table_, 1) if n else np.empty((0, 9), np.int64))


@dataclass
class Field:
    """Weights of features by tag, and of a tag after another.

    ``check`` has the further 16 bits of the hash that a bucket stands for, so that another word
    in the bucket has no weight.
    """

    emit: np.ndarray
    move: np.ndarray
    check: np.ndarray | None = None

    def score(self, features: np.ndarray) -> np.ndarray:
        place = features & 0xFFFFFFFF
        if self.check is None:
            return self.emit[place].sum(1)
        return self.emit[np.where(self.check[place] == features >> 32, place, SIZE)].sum(1)

    def tags(self, t: Tokens) -> np.ndarray:
        """The best tags of each text; before and after a text the tag counts as outside."""
        score = self.score(t.features)
        tags = np.zeros(len(score), np.int64)
        m = self.move
        gain = [max(m[a, y] + m[y, b] - m[a, O] - m[O, b] for a in range(3) for b in range(3)) for y in (B, I)]
        open_ = (score[:, O] - score[:, B] <= gain[0]) | (score[:, O] - score[:, I] <= gain[1])
        begin = open_.copy()
        begin[1:] &= ~open_[:-1]
        edge = t.first[:-1][t.first[:-1] < len(open_)]
        begin[edge] |= open_[edge]
        start = np.flatnonzero(begin)
        if not len(start):
            return tags
        stop = np.zeros(len(open_) + 1, bool)
        stop[np.flatnonzero(~open_)] = True
        stop[edge] = stop[-1] = True
        ends = np.flatnonzero(stop)
        end = ends[np.searchsorted(ends, start + 1)]
        length = end - start
        for lo, hi in ((1, 1), (2, 2), (3, 4), (5, 8), (9, 16), (17, 64)):
            some = np.flatnonzero((length >= lo) & (length <= hi))
            for part in np.array_split(some, max(1, len(some) * hi // 200_000)):
                if len(part):
                    self._viterbi(score, tags, start[part], length[part])
        for k in np.flatnonzero(length > 64):
            self._viterbi(score, tags, start[k : k + 1], length[k : k + 1])
        return tags

    def _viterbi(self, score: np.ndarray, tags: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        n, width, rows = len(start), int(length.max()), np.arange(len(start))
        back = np.zeros((width, n, 3), np.int64)
        best = score[start] + self.move[O]
        for s in range(1, width):
            here = s < length
            step = best[:, :, None] + self.move[None]
            back[s] = np.where(here[:, None], step.argmax(1), np.arange(3))
            best = np.where(here[:, None], step.max(1) + score[np.minimum(start + s, len(score) - 1)], best)
        tag = (best + self.move[:, O]).argmax(1)
        for s in range(width - 1, -1, -1):
            here = s < length
            tags[start[here] + s] = tag[here]
            if s:
                tag = back[s][rows, tag]


# Generated lines ------------------------------------------------------------------------------

_SYLLABLES = ("an on re st in er th ou ing tion ble ly de la que os as mente ra do ir ción der ein ung sch keit lich heit zu be ge le eau oi é ch eux ment co ki ta mo ru na vo sha po ne "
              "да ни ка то ле но за").split()  # fmt: skip
_FILL = "the of and to in is for with by on der die und zu que de la el les des et un est pour a an are was this that from".split()
_NAMES = "password password passwd pwd pass db_pass secret token api_key apikey access_key secret_key auth_token client_secret private_key credentials passphrase access_token refresh_token".split()
_PLAIN = "commit sha sha256 md5 checksum digest etag revision id uuid order invoice build hash tree parent version path file page ref".split()
_HEXD, _B62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_B32, _B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


class _Lines:
    """Texts with the places of their secrets."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def some(self, alphabet: str, low: int, high: int | None = None) -> str:
        return "".join(self.r.choices(alphabet, k=self.r.randint(low, high or low)))

    def word(self) -> str:
        r = self.r
        if r.random() < 0.05:
            return r.choice("aeioyunsxzk") if r.random() < 0.7 else r.choice(_B62[:52])
        w = r.choice(_FILL) if r.random() < 0.35 else "".join(r.choices(_SYLLABLES, k=r.choice((1, 1, 2, 2, 3, 4, 5))))
        return w.capitalize() if r.random() < 0.12 else w.upper() if r.random() < 0.02 else w

    def prose(self, n: int) -> str:
        return " ".join(self.word() + self.r.choice(("", "", "", "", "", "", ",", ".", ".\n", ";", " |")) for _ in range(n))

    def name(self, names: list[str]) -> str:
        r = self.r
        n = r.choice(names)
        if r.random() < 0.2:
            n = f"{r.choice(('db', 'app', 'my', 'aws', 'user', 'prod', 'service'))}_{n}"
        return n.upper() if r.random() < 0.2 else n.capitalize() if r.random() < 0.05 else n.replace("_", "-") if r.random() < 0.1 else n

    def assign(self, names: list[str], value: str) -> tuple[str, str, str]:
        quote = self.r.choice(('"', '"', "'", "", ""))
        return self.name(names) + self.r.choice(("=", " = ", ": ", ":", " := ", "=", " = ")) + quote, value, quote

    def value(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.45:
            return self.some(_HEXD, 12, 64)
        if kind < 0.75:
            return self.some(_B62, 12, 48)
        if kind < 0.85:
            return self.some(_B64, 20, 60)
        if kind < 0.9:
            return r.choice("abcdefghijkmnpqrstuvwxyz").upper() + self.some("abcdefghijkmnpqrstuvwxyz", 3, 7) + self.some("23456789", 1, 4) + r.choice(("", "_", "-")) + self.some(_B62, 0, 5)
        return self.chosen()

    def chosen(self) -> str:
        """A password as people choose them: a word with digits, words in a row, or letters, digits and signs."""
        r = self.r
        word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 8))) if r.random() < 0.3 else "".join(w for w in r.choices(_SYLLABLES, k=r.choice((1, 2, 2, 3))) if w.isascii()) or "ora"
        kind = r.random()
        if kind < 0.35:
            return (word() + word()).capitalize() + self.some("0123456789", 1, 4) if r.random() < 0.4 else word() + word() + self.some("0123456789", 1, 4)
        if kind < 0.5:
            return r.choice("-_-").join(word() for _ in range(r.randint(3, 5)))
        mixed = "".join({"e": "3", "a": "@", "o": "0", "i": "1", "s": "$"}.get(c, c) if r.random() < 0.6 else c for c in word() + word())
        mixed = mixed.capitalize() if r.random() < 0.5 else mixed
        return mixed + self.some("0123456789", 0 if any(c.isdigit() for c in mixed) else 2, 4) + r.choice(("!", "!", "#", "$", "%", "&", "*", "?", "@", "!!", "&" + self.some("0123456789", 1, 2), "!" + word()))

    def secret(self) -> tuple[str, str, str]:
        r = self.r
        kind = r.random()
        if kind < 0.34:
            return self.assign(_NAMES, self.value())
        if kind < 0.42:
            return self.assign([n for n in _NAMES if n[:2] in ("pa", "pw", "db")], self.chosen())
        if kind < 0.56:
            return "", r.choice(("AKIA", "AKIA", "ASIA")) + self.some(_B32, 16), ""
        if kind < 0.72:
            if r.random() < 0.12:  # an address that posts for whoever knows it
                capitals = _B62[:26] + "0123456789"
                return "https:", r.choice((f"//hooks.slack.com/services/T{self.some(capitals, 8, 10)}/B{self.some(capitals, 8, 10)}/{self.some(_B62, 24)}", f"//discord.com/api/webhooks/{self.some('0123456789', 18)}/{self.some(_B62 + '_-', 68)}")), ""
            key = r.choice((f"ghp_{self.some(_B62, 36)}", f"gho_{self.some(_B62, 36)}", f"sk-{self.some(_B62, 32, 48)}", f"xoxb-{self.some('0123456789', 11)}-{self.some(_B62, 24)}", f"AIza{self.some(_B62 + '_-', 35)}", f"glpat-{self.some(_B62, 20)}", f"sk_live_{self.some(_B62, 24)}", f"npm_{self.some(_B62, 36)}", f"hf_{self.some(_B62, 30, 40)}", f"SG.{self.some(_B62 + '_-', 22)}.{self.some(_B62 + '_-', 43)}", f"github_pat_{self.some(_B62, 22)}_{self.some(_B62, 59)}", f"shpat_{self.some(_HEXD, 32)}", f"dop_v1_{self.some(_HEXD, 64)}", f"GOCSPX-{self.some(_B62, 28)}", f"whsec_{self.some(_B62, 32)}", f"pypi-{self.some(_B62 + '_-', 60, 120)}", f"hf_{''.join(r.choices(_B62[:52], k=34))}"))
            return ("", key, "") if r.random() < 0.6 else self.assign(_NAMES + ["key"], key)
        if kind < 0.8:
            return r.choice(("Authorization: Bearer ", "bearer ", "Authorization: Basic ", "X-Api-Key: ")), r.choice((self.some(_B62, 24, 60), self.some(_HEXD, 32, 64))), ""
        if kind < 0.87:
            return r.choice(("", "jwt=", "token: ")), f"eyJ{self.some(_B62, 17, 40)}.eyJ{self.some(_B62, 20, 60)}.{self.some(_B62 + '_-', 30, 50)}", ""
        if kind < 0.94:
            what = r.choice(("RSA PRIVATE KEY", "PRIVATE KEY", "OPENSSH PRIVATE KEY", "EC PRIVATE KEY", "PGP PRIVATE KEY BLOCK", "PGP PRIVATE KEY BLOCK"))
            if "PGP" in what:
                return "", f"-----BEGIN {what}-----\n" + r.choice(("", f"Version: {r.choice(('1', '2.0', 'GnuPG v2'))}\n", "Comment: key\n")) + "\n" + "\n".join(self.some(_B64, 64) for _ in range(r.randint(1, 5))) + f"\n{self.some(_B64, 10, 60)}\n={self.some(_B64, 4)}\n-----END {what}-----", ""
            return "", f"-----BEGIN {what}-----\n" + "\n".join(self.some(_B64, 64) for _ in range(r.randint(1, 5))) + f"\n{self.some(_B64, 10, 60)}==\n-----END {what}-----", ""
        return f"{r.choice(('postgres', 'mysql', 'redis', 'https', 'amqp'))}://{r.choice(('admin', 'root', 'user', 'app'))}:", self.some(_B62, 8, 24), f"@{r.choice(('db', 'cache', 'host'))}.example.com:5432/main"

    def signs(self) -> str:
        """Words among runs of signs, as in shouting, lists, tables and torn pages."""
        r = self.r
        sign = lambda: r.choice("!!?#$%&*@^|~;:.,") * r.choice((1, 1, 2, 3, 4))
        word = lambda: self.word().upper() if r.random() < 0.4 else self.word() + r.choice(("", "", self.some("0123456789", 1, 3)))
        return "".join(r.choice(("", "", " ", sign(), sign() + " ")) + word() + r.choice((sign(), sign() + " ", " ", "\n")) for _ in range(r.randint(2, 12)))

    def harmless(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.15:
            return self.signs()
        if kind < 0.25:
            name, value = r.choice(_PLAIN), self.some(_HEXD, r.choice((7, 12, 32, 40, 64)))
            return f"{name} {value}" if r.random() < 0.5 else "".join(self.assign(_PLAIN, value))
        digits = lambda a, b=None: self.some("0123456789", a, b)
        uuid = "-".join(self.some(_HEXD, k) for k in (8, 4, 4, 4, 12))
        return r.choice((
            lambda: f"{r.choice(_PLAIN)} {self.some(_HEXD, r.choice((7, 12, 32, 40, 64)))}", lambda: "".join(self.assign(_PLAIN, self.some(_HEXD, r.choice((8, 32, 40, 64))))),
            lambda: "".join(self.assign(_PLAIN, uuid)), lambda: uuid, lambda: digits(16), lambda: digits(3, 12), lambda: f"{digits(2)}.{digits(2, 3)}.{digits(1, 3)}.{digits(2)}",
            lambda: f"+{digits(1, 2)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(4)}", lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}", lambda: f"{digits(1)}.{digits(1)}.", lambda: f"v{digits(1)}.{digits(1, 2)}.{digits(1)}",
            lambda: f"{self.word()}.{self.word()}{digits(0, 2)}@mail{digits(1)}.example.com", lambda: f"https://example.com/{self.word()}/{digits(2, 6)}/{self.some(_HEXD, 8, 20)}?page={digits(1, 3)}",
            lambda: f"{self.name(_NAMES)} = {r.choice(('None', 'null', 'input()', 'getpass()', 'os.environ', 'next(lexer)', 'request.token', 'config.get(name)', 'true', '0', 'false'))}",
            lambda: f"{self.name(_NAMES)}: {self.word()}", lambda: f"the {r.choice(_NAMES)} {self.word()} {self.word()}", lambda: f"{r.choice(_NAMES)} = \"{self.word()}\"", lambda: f"if {r.choice(_NAMES)} == \"{self.word()}\":",
            lambda: f"{r.choice(_NAMES)}: {r.choice(('required', 'optional', 'none', 'yes', 'str', 'changed', 'reset', 'ok'))}", lambda: f"{self.word()}{r.choice(('-', '_'))}{self.word()}{r.choice(('-', '_'))}{self.word()}", lambda: f"class=\"{self.word().lower()}-{self.word().lower()}-{self.word().lower()}\"", lambda: f"https://{r.choice(('example.com', 'hooks.example.com', 'discord.com', 'slack.com'))}/{self.word().lower()}-{self.word().lower()}/20{digits(2)}/{digits(2)}/{self.word().lower()}", lambda: f"{self.word()}{digits(1, 4)}!", lambda: f"{self.word()} & {self.word()} {digits(4)}!", lambda: f"{self.word().lower()}{digits(1, 3)} = {self.word().lower()}{digits(1, 3)}", lambda: f"{r.choice(('name', 'user', 'host', 'file', 'mode'))}: {self.word().lower()}{digits(1, 3)}", lambda: f"{r.choice(('name', 'user', 'host', 'file', 'title'))} = \"{self.word().lower()}-{self.word().lower()}-{self.word().lower()}\"", lambda: f"pass the {self.word()}, pass {self.word()}", lambda: f"the {r.choice(('password', 'token', 'secret'))} must be {digits(1, 2)} {self.word()}",
            lambda: f"#{self.some(_HEXD, 6)}", lambda: f"Licensed under CC BY-NC {digits(1)}.0.", lambda: f"ISBN 978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", lambda: f"/usr/lib/{self.word()}-{digits(1)}.{digits(1)}/{self.word()}.py", lambda: f"{self.some('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 2, 8)}{digits(1, 6)}", lambda: f"{self.some('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 9, 22)}", lambda: "=" * r.randint(3, 40), lambda: f"<div class=\"{self.word()}\" id=\"{self.word()}{digits(1, 3)}\">", lambda: f"def {self.word()}({self.word()}, {self.word()}={digits(1)}):", lambda: "".join(self.word() for _ in range(r.randint(3, 7))), lambda: "".join(self.word().lower() for _ in range(r.randint(2, 7))).capitalize(), lambda: "".join(self.word().lower() for _ in range(r.randint(3, 5))).capitalize() + r.choice((".", ",", "")), lambda: "".join(r.choices(_SYLLABLES, k=r.randint(4, 10))).capitalize() + r.choice((".", ",", "")), lambda: "".join(r.choices(_SYLLABLES, k=r.randint(4, 8))).capitalize(), lambda: " ".join([self.word()] * r.randint(3, 25)) + r.choice((" ", "")) + self.word(),
        ))()

    def text(self, share: float = 0.6) -> tuple[str, list[tuple[int, int]]]:
        r, text, secrets = self.r, "", []
        for _ in range(r.randint(1, 4)):
            text += self.prose(r.randint(0, 30)) + r.choice((" ", " ", "\n"))
            if r.random() < share:
                left, value, right = self.secret()
                secrets.append((len(text) + len(left), len(text) + len(left) + len(value)))
                text += left + value + right
            else:
                text += self.harmless()
            text += r.choice((" ", "\n", ". ", ", ", "; "))
        return text + self.prose(r.randint(0, 10)), secrets


def generated(n: int, seed: int, share: float = 0.5) -> tuple[list[str], list[list[tuple[int, int]]]]:
    """Texts and the (begin, end) of their secrets, in characters."""
    lines = _Lines(seed)
    made = [lines.text(share) for _ in range(n)]
    return [m[0] for m in made], [m[1] for m in made]


def _encode(texts: list[str]) -> Tokens:
    _, _, data, offsets = next(chunked(pa.array(texts, pa.large_string()), lower=False, limit=1 << 40))
    return tokens(data, offsets)


@lru_cache(maxsize=4)
def train(n: int = 3000, seed: int = 11, steps: int = 110, ridge: float = 1e-5) -> Field:
    """The field of maximal (penalised) likelihood over generated lines."""
    texts, secrets = generated(n, seed)
    t = _encode(texts)
    size = np.diff(t.first)
    gold = np.zeros(len(t.start), np.int64)
    byte = 0
    for k, (text, found) in enumerate(zip(texts, secrets)):
        for a, b in found:
            a, b = (byte + len(text[:x].encode()) for x in (a, b))
            at = np.flatnonzero((t.start[t.first[k] : t.first[k + 1]] < b) & (t.end[t.first[k] : t.first[k + 1]] > a)) + t.first[k]
            gold[at], gold[at[0]] = I, B
        byte += len(text.encode())
    used, local, often = np.unique(t.features, return_inverse=True, return_counts=True)
    local = local.reshape(t.features.shape)
    width, order = int(size.max()), np.argsort(-size)
    live = [int((size > s).sum()) for s in range(width)]  # texts, longest first, that have a token at s
    at = [t.first[:-1][order[: live[s]]] + s for s in range(width)]
    w, move = np.zeros((len(used), 3)), np.zeros((3, 3))
    rare = ((often < LEAST) & ((used & 0xFFFFFFFF) >= _HASHED))[:, None]
    m, v = np.zeros(w.size + 9), np.zeros(w.size + 9)
    truth = np.zeros((len(gold), 3))
    truth[np.arange(len(gold)), gold] = 1
    before = np.concatenate([[O], gold[:-1]])
    before[t.first[:-1]] = O
    seen = np.zeros((3, 3))
    np.add.at(seen, (before, gold), 1)
    np.add.at(seen, (gold[t.first[1:] - 1], np.zeros(n, np.int64)), 1)
    flat = local.ravel()
    for step in range(1, steps + 1):
        score = sum(w[local[:, k]] for k in range(local.shape[1]))
        em, ex = np.exp(move), np.exp(score - score.max(1, keepdims=True))
        alpha, beta, scale = np.zeros_like(ex), np.zeros_like(ex), np.ones(len(ex))
        for s in range(width):
            a = np.broadcast_to(em[O], (live[s], 3)) * ex[at[s]] if s == 0 else (alpha[at[s] - 1] @ em) * ex[at[s]]
            scale[at[s]] = a.sum(1)
            alpha[at[s]] = a / scale[at[s]][:, None]
        final = t.first[1:] - 1
        z = alpha[final] @ em[:, O]
        expect = np.zeros((3, 3))
        beta[final] = em[:, O] / z[:, None]
        for s in range(width - 1, 0, -1):
            cur = at[s]
            out = ex[cur] * beta[cur] / scale[cur][:, None]
            expect += (alpha[cur - 1].T @ out) * em
            beta[cur - 1] = out @ em.T
        p0 = alpha * beta
        p = p0 / p0.sum(1, keepdims=True)
        expect[O] += p[t.first[:-1]].sum(0)
        expect[:, O] += p[final].sum(0)
        err = (p - truth) / n
        grad = np.concatenate([np.stack([np.bincount(flat, np.repeat(err[:, c], 9), len(used)) for c in range(3)], 1).ravel() + 2 * ridge * w.ravel(), ((expect - seen) / n).ravel() + 2 * ridge * move.ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.98 * v + 0.02 * grad**2
        delta = 0.12 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-7) * min(1.0, 2 * (1 - step / (steps + 1)))
        w, move = w - np.where(rare, 0, delta[: w.size].reshape(w.shape)), move - delta[w.size :].reshape(3, 3)
    emit, check = np.zeros((SIZE + 1, 3), np.float32), np.full(SIZE, -1, np.int32)
    by = np.argsort(often, kind="stable")  # of several in a bucket the most frequent stays
    emit[used[by] & 0xFFFFFFFF], check[used[by] & 0xFFFFFFFF] = w[by], used[by] >> 32
    return Field(emit, move, check)


def spans(field: Field, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end, tokens) of each secret, in bytes of ``t.data``."""
    tags = field.tags(t)
    at = np.flatnonzero(tags != O)
    owner = np.searchsorted(t.first, at, "right") - 1
    new = np.concatenate([[True], (np.diff(at) != 1) | (tags[at[1:]] == B) | (np.diff(owner) != 0)]) if len(at) else np.empty(0, bool)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(at))[: len(head)] - 1
    begin, end = t.start[at[head]], t.end[at[last]]
    end = end - ((t.data[end - 1] == 46) & (end - begin > 1) if len(end) else 0)
    return owner[head], begin, end, last - head + 1


def _characters(data: np.ndarray) -> np.ndarray:
    """How many characters begin before each byte."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", field: Field | None = None) -> DataFrame:
    """(doc_id, begin, end, secret, tokens) of every secret."""
    handle = docs.sparkSession.sparkContext.broadcast(field or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunked(batch.column(1), lower=False):
                t = tokens(data, offsets)
                owner, begin, end, n = spans(handle.value, t)
                if not len(owner):
                    continue
                base = (offsets - offsets[0])[owner]
                place = _characters(t.data)
                value = [t.data[a:b].tobytes().decode() for a, b in zip(begin, end)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(owner)), pa.array((place[begin] - place[base]).astype(np.int32)), pa.array((place[end] - place[base]).astype(np.int32)), pa.array(value, pa.string()), pa.array(n.astype(np.int32))], ["doc_id", "begin", "end", "secret", "tokens"])

    rows = batched(docs).select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(run, "doc_id long, begin int, end int, secret string, tokens int")


def redacted(docs: DataFrame, text: str = "text", length: str = "n_chars", mask: str = MASK, field: Field | None = None) -> DataFrame:
    """``docs`` with ``mask`` in place of every secret; ``length``, where there is such a column, follows the text."""
    handle, place = docs.sparkSession.sparkContext.broadcast(field or train()), docs.columns.index(text)
    counted = docs.columns.index(length) if length in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            new: dict[int, str] = {}
            for lo, hi, data, offsets in chunked(column, lower=False):
                t = tokens(data, offsets)
                owner, begin, end, _ = spans(handle.value, t)
                base = offsets - offsets[0]
                for k in np.unique(owner):
                    parts, at = [], int(base[k])
                    for a, b in zip(begin[owner == k], end[owner == k]):
                        parts += [t.data[at:a].tobytes().decode(), mask]
                        at = int(b)
                    new[lo + int(k)] = "".join([*parts, t.data[at : base[k + 1]].tobytes().decode()])
            if new:
                columns = list(batch.columns)
                order = np.arange(batch.num_rows)
                order[np.array(list(new))] = batch.num_rows + np.arange(len(new))
                merge = lambda old, values: pa.concat_arrays([old, pa.array(values).cast(old.type)]).take(pa.array(order))
                columns[place] = merge(column, list(new.values()))
                if counted is not None:
                    columns[counted] = merge(columns[counted], [len(x) for x in new.values()])
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return batched(docs).mapInArrow(run, docs.schema)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op1_secrets": op1_secrets}
ORACLE_SQL: dict[str, str] = {}

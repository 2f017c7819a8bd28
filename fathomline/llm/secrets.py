r"""Secret scans: fixed patterns, and zstandard novelty for what they miss.

The patterns find assignments, access keys and hex runs.  Beyond them, a candidate is a run of 20 or
more key-like characters with digits and letters that stands within CONTEXT characters after a
sensitive word, or a whole line of them that follows such a run's line.  The body of a private key from
BEGIN to END (without END, its lines of key characters) is one candidate.  A candidate's novelty is what it adds to the compressed size of its surroundings, with a
dictionary of usual identifiers primed: bytes added over bytes of the candidate.  Names, paths
and repeated values are in the surroundings or the dictionary already and add little; a random key
adds nearly all of its bytes.  A private key's body is compressed by itself: a second copy is as secret.

Spans are code points, end exclusive, of the whole match.  Defined results: a null text is empty;
repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
SENSITIVE = re.compile(
    r"password|passwd|passphrase|secret|token|(?:api|access|private|session)[-_\x20]?key|auth|bearer|credential|signature|client[-_\x20]?id", re.ASCII | re.IGNORECASE
)
BREAK = r"(?:\r?\n|\r|\\r\\n|\\n)"
#: The next line, if it holds one run of key-like characters and nothing else but quotes and joints.
NEXT_LINE = re.compile(rf"""["'+,;\x20\t]*{BREAK}["'\x20\t]*([A-Za-z0-9+/_=-]{{4,}})(?=["'+,;\x20\t]*(?:{BREAK}|$))""")
KEY_MARK = re.compile(r"-{4,5}\x20?(BEGIN|END)\x20(?:[A-Z0-9]+\x20)*PRIVATE\x20KEY(?:\x20BLOCK)?\x20?-{4,5}")
KEY_LINES = re.compile(r"(?:(?:\s|\\[rn]|[\"'])*[A-Za-z0-9+/=]{16,})*(?:(?:\s|\\[rn]|[\"'])+[A-Za-z0-9+/]+={1,2})?")
KEY_EDGE = re.compile(r"(?:\s|\\[rn]|[\"',;])+")
NEEDED = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Characters before a candidate in which a sensitive word makes it one; and the surroundings that are compressed with it.
CONTEXT = 64
BEFORE, AFTER = 2048, 512
#: Share of a candidate's bytes that must be new.
NOVELTY = 0.6
IDENTIFIERS = (
    "https://www.example.com/index.html?id=user&page=session&session_id=request_id&client_id=application/json;charset=utf-8 "
    "Authorization: Bearer access_token refresh_token client_secret private_key public_key api_key password username email "
    "configuration environment development production localhost connection database_url signature timestamp version "
    "/usr/local/lib/python3/site-packages/ /usr/share/ /home/user/.config/ /var/log/ /etc/ssl/certs/ C:/Program Files/ node_modules/src/main/java/org/ "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000-0000-0000-0000-000000000000 "
    "getElementById addEventListener createSession setAttribute AbstractFactory ServiceProvider RequestHandler "
    "placeholder_value_here your_api_key_here your-secret-token-here changeme example_key_not_real xxxxxxxxxxxxxxxxxxxxxxxx"
).encode()

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the fixed patterns, in order."""
    found: list[Span] = []
    lower = text.lower()
    if any(word in lower for word in NEEDED):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Novelty:
    """Marginal compressed size under a primed dictionary."""

    def __init__(self) -> None:
        import zstandard

        primed = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False).compress

    def share(self, before: str, candidate: str, after: str) -> float:
        around, own = (before + "\n" + after).encode("utf-8", "replace"), candidate.encode()
        return (len(self.compress(around + b"\n" + own)) - len(self.compress(around))) / len(own)

    def private_keys(self, text: str) -> list[Span]:
        """Bodies of private keys between their marks."""
        found: list[Span] = []
        marks = list(KEY_MARK.finditer(text)) if "PRIVATE KEY" in text else []
        for m, after in zip(marks, [*marks[1:], None], strict=False):
            if m[1] == "END":
                continue
            ended = after is not None and after[1] == "END"
            start, end = m.end(), after.start() if ended else KEY_LINES.match(text, m.end()).end()
            if edge := KEY_EDGE.match(text, start, end):
                start = edge.end()
            while end > start and (text[end - 1].isspace() or text[end - 2 : end] in {"\\n", "\\r"}):
                end -= 1 if text[end - 1].isspace() else 2
            value = KEY_EDGE.sub("", text[start:end])
            if len(value) >= 20 and self.share("", value, "") >= NOVELTY:
                found.append((start, 3, end))
        return found

    def spans(self, text: str, known: list[Span]) -> list[Span]:
        found = self.private_keys(text)
        known = known + found

        def new(start: int, end: int) -> bool:
            if any(s < end and start < e for s, _, e in known):
                return False
            return self.share(text[max(0, start - BEFORE) : start], text[start:end], text[end : end + AFTER]) >= NOVELTY

        def mixed(value: str) -> bool:
            return bool(DIGIT.search(value) and LETTER.search(value))

        at = 0
        while m := CANDIDATE.search(text, at):
            start, at = m.start(), m.end()
            sensitive = SENSITIVE.search(text, max(0, start - CONTEXT), start)
            # name=value is one run: the name is its context.
            name = m[0].find("=") + 1
            if name and len(m[0]) - name >= 20 and SENSITIVE.search(text, start, start + name):
                sensitive, start = True, start + name
            if not sensitive or not mixed(text[start:at]):
                continue
            width, kept = at - start, new(start, at)
            if kept:
                found.append((start, 3, at))
            while line := NEXT_LINE.match(text, at):
                value, short = line[1], len(line[1]) < 20
                # The short last line of a secret, not a word of prose.
                if not (mixed(value) or (short and value.endswith("="))) or (short and not (kept and len(value) < width)):
                    break
                at, width, kept = line.end(1), len(value), new(line.start(1), line.end(1))
                if kept:
                    found.append((line.start(1), 3, at))
                if short:
                    break
        return found


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """All columns of docs and a struct `out`: n_assign, n_access, n_hex, n_novel, base_spans and spans (strings).

    A column of docs that is named like `out` is an error, for it would be lost.
    """
    if out.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the documents have a column {out!r} already: name the result otherwise")

    @F.pandas_udf("n_assign long, n_access long, n_hex long, n_novel long, base_spans string, spans string")
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        novelty = Novelty()
        for batch in texts:
            rows = []
            for value in batch:
                base = base_spans(value)
                everything = sorted(base + novelty.spans(value, base))
                rows.append((*(sum(k == n for _, k, _ in everything) for n in range(4)), _joined(base), _joined(everything)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_novel", "base_spans", "spans"])

    return docs.withColumn(out, scan(F.coalesce(F.col(text), F.lit(""))))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span of text replaced by mark; a null text stays null."""

    @F.pandas_udf("string")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        novelty = Novelty()
        for batch in texts:
            out = []
            for value in batch:
                base = base_spans(value) if value is not None else []
                spans = sorted(base + novelty.spans(value, base)) if value is not None else []
                pieces, at = [], 0
                for start, _, end in spans:
                    if end > at:
                        if start >= at:
                            pieces += [value[at:start], mark]
                        at = end
                out.append("".join([*pieces, value[at:]]) if spans else value)
            yield pd.Series(out, dtype=object)

    return docs.withColumn(text, clean(F.col(text)))

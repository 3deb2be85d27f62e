"""Reading one archive file inside a task: its member, cut at element borders when it is long."""

from __future__ import annotations

import codecs
import io
import re
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs

from postaudit import schema as S

BLOCK_BYTES = 4 << 20
CHUNK_CHARS = 8 << 20

# A complete string, the quote of one that goes on behind the buffer, or a structural character.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+"|(?P<cut>")|(?P<mark>[\[\]{},])', re.DOTALL)


def post_members(names: Iterable[str], all_parts: bool = False) -> list[str]:
    """Entries that hold posts, in archive order: the first, or every one with `all_parts`."""
    fitting = [n for n in names if "tweet" in n.lower() and n.lower().endswith(".js")]
    return fitting if all_parts else fitting[:1]


def text_blocks(stream) -> Iterator[tuple[str, bool]]:
    """Blocks of text with a mark on the last."""
    decoder = codecs.getincrementaldecoder("utf-8")(errors="replace")
    while block := stream.read(BLOCK_BYTES):
        yield decoder.decode(block), False
    yield decoder.decode(b"", final=True), True


def _array_start(text: str, final: bool) -> int | None:
    """Where the array opens, the rule of unwrap_js; None while the text seen does not tell."""
    head = len(text) - len(text.lstrip(S.WHITE_SPACE))
    if text[head:head + 1] == "[":
        return head
    equals = text.find("=")
    if equals < 0 and not final:
        return None
    rest = text[equals + 1:] if equals >= 0 else ""
    assigned = rest.lstrip(S.WHITE_SPACE)
    if equals >= 0 and not assigned and not final:
        return None
    if assigned.startswith("["):
        return len(text) - len(assigned)
    first = text.find("[")
    return first if first >= 0 else None


def element_chunks(blocks: Iterable[tuple[str, bool]],
                   chunk_chars: int = CHUNK_CHARS) -> Iterator[tuple[int, str | None]]:
    """Cut the array in a stream of text into (number of first element, JSON array text) pieces.

    Only the current piece is held. As for a text that is not cut, an empty piece tells that no array opens or
    no bracket closes behind it, and None that the array is not closed, has an empty element at a
    cut, or is followed by another `]`.
    """
    buffer, at, depth = "", 0, 0
    opened = closed = ends = False
    first = count = 0
    for block, final in blocks:
        buffer += block
        if not opened:
            start = _array_start(buffer, final)
            if start is None:
                continue
            buffer, depth, opened = buffer[start + 1:], 1, True
            ends = "]" in buffer
        else:
            ends = ends or "]" in block
        begin = 0
        while not closed:
            token = _TOKEN.search(buffer, at)
            if token is None or token["cut"]:
                at = len(buffer) if token is None else token.start()
                break
            at, mark = token.end(), token["mark"]
            if mark in ("[", "{"):
                depth += 1
            elif mark in ("]", "}"):
                depth -= 1
            closed = depth == 0
            cut = mark == "," and depth == 1 and token.start() - begin >= chunk_chars
            if closed or cut:
                piece = buffer[begin:token.start()]
                if (mark == "}" and closed) or (not piece.strip() and (cut or count > 0)):
                    yield first, None
                    return
                yield first, f"[{piece}]"
                first, begin = count + 1, at
            if mark == "," and depth == 1:
                count += 1
        buffer, at = buffer[begin:], at - begin
        if closed:
            if "]" in buffer:
                yield first, None
                return
            buffer, at = "", 0
    if not closed:
        yield first, None if ends else ""


def open_path(path: str) -> io.RawIOBase:
    """A file as a stream that seeks, so that a ZIP's directory and a member's blocks are all that is read of it."""
    scheme, mark, rest = path.partition("://")
    if not mark or scheme == "file":  # the binaryFile source gives file:/a/b, with no character escaped
        return fs.LocalFileSystem().open_input_file(re.sub(r"^file:/+", "/", path))
    host, _, place = rest.partition("/")
    system, place = fs.FileSystem.from_uri(f"{re.sub('^s3[an]$', 's3', scheme)}://{host}/{quote(place)}")
    return system.open_input_file(place)


def read_path(path: str, all_parts: bool = False, chunk_chars: int = CHUNK_CHARS) -> Iterator[dict]:
    """Pieces of the archive at `path`, see read_archive; memory doesn't grow with the file."""
    try:
        with open_path(path) as stream:
            yield from read_archive(stream, all_parts, chunk_chars)
    except (OSError, ValueError, pa.ArrowException) as failure:
        yield _piece(error=f"{S.ERROR_OPEN}: {type(failure).__name__}")


def read_archive(content: bytes | io.RawIOBase, all_parts: bool = False,
                 chunk_chars: int = CHUNK_CHARS) -> Iterator[dict]:
    """Pieces of one archive, its bytes or a stream that seeks: member, first_pos, js, cut, error.

    A member of ordinary length is one piece holding the JS text as it is (cut False); unwrapping
    and parsing are left to Spark. A longer one is cut into JSON arrays (cut True).
    """
    stream = io.BytesIO(content) if isinstance(content, bytes) else content
    try:
        magic = bytes.fromhex(S.ZIP_MAGIC_HEX)
        is_zip = stream.read(len(magic)) == magic
        size = stream.seek(0, io.SEEK_END)
        stream.seek(0)
        if not is_zip:
            yield from _read_member(stream, size, "", chunk_chars)
            return
        with zipfile.ZipFile(stream) as archive:
            names = post_members(archive.namelist(), all_parts)
            if not names:
                yield _piece(error=S.ERROR_NO_MEMBER)
            for name in names:
                with archive.open(name) as member:
                    yield from _read_member(member, archive.getinfo(name).file_size, name, chunk_chars)
    except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError) as failure:
        yield _piece(error=f"{S.ERROR_ZIP}: {failure}")


def _read_member(stream, size: int, name: str, chunk_chars: int) -> Iterator[dict]:
    if size <= chunk_chars:
        yield _piece(name, js=stream.read().decode("utf-8", errors="replace"))
        return
    for first, text in element_chunks(text_blocks(stream), chunk_chars):
        if not text:
            yield _piece(name, first, cut=True, error=S.ERROR_JSON if text is None else S.ERROR_UNWRAP)
        else:
            yield _piece(name, first, text, cut=True)


def _piece(member: str | None = None, first_pos: int = 0, js: str | None = None, cut: bool = False,
           error: str | None = None) -> dict:
    return {"member": member, "first_pos": first_pos, "js": js, "cut": cut, "error": error}

"""SentencePiece encoding with byte spans of the original text, and decoding.

Ids are the library's own. A long text is encoded and decoded in parts, cut only between two
characters that no piece of the model holds side by side: no merge of the BPE can reach over such a
place, so the parts' ids are those of the whole text, and memory does not grow with it as the library's
(some 50 bytes a character) does.

Spans come from ``normalizer``: longest-prefix normalisation records each normalised
byte's source, and the pieces, which tile the normalised text, project to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame

from pondflow.llm.common import documents, release, text_slices
from pondflow.llm.normalizer import Normalizer

SLICE = 2 << 20  # bytes of text turned into rows at a time
PART_CHARS = 1 << 16  # characters of a text given to the library at once, up to the next place to cut


class Encoder:
    """One model in one task."""

    def __init__(self, path: str, goes_on: bool = False):
        """goes_on: for what follows in a text that has begun, so without the dummy prefix."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        norm.add_dummy_prefix &= not goes_on
        self.path, self.model = path, sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.normalize = Normalizer(norm.precompiled_charsmap, norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces)
        byte = proto.ModelProto.SentencePiece.BYTE
        self.sizes = np.array([1 if p.type == byte else len(p.piece.encode()) for p in spec.pieces], np.int64)
        self.by_id = spec.trainer_spec.byte_fallback  # else an unknown piece's length depends on the text
        # where only spaces change, a piece's source is as long as its text with ▁ as a space
        self.spaces_only = (not norm.precompiled_charsmap and not norm.remove_extra_whitespaces
                            and norm.escape_whitespaces and self.by_id)
        self.prefix = int(norm.add_dummy_prefix)
        self.plain = np.array([1 if p.type == byte else len(p.piece.replace("▁", " ").encode()) for p in spec.pieces], np.int64)
        # pairs of characters inside pieces; None where a text's ids may depend on more than those
        self.pairs = None
        if (self.spaces_only and spec.trainer_spec.model_type == proto.TrainerSpec.BPE and not spec.trainer_spec.treat_whitespace_as_suffix
                and all(p.type != proto.ModelProto.SentencePiece.USER_DEFINED for p in spec.pieces)):
            self.pairs = {a + b for p in spec.pieces if p.type != byte for a, b in zip(p.piece, p.piece[1:])}

    @cached_property
    def rest(self) -> Encoder:
        """The encoder of a text's later parts."""
        return Encoder(self.path, goes_on=True)

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts of about ``PART_CHARS``, or itself where it is short or has no place to cut."""
        at = 0
        while (cut := self._cut(text, at + PART_CHARS)) < len(text):
            yield text[at:cut]
            at = cut
        yield text[at:]

    def _cut(self, text: str, least: int) -> int:
        """The first place from ``least`` on that no piece reaches over, or the text's end."""
        if self.pairs is not None:
            for at in range(least, len(text)):
                if text[at - 1:at + 1].replace(" ", "▁") not in self.pairs:
                    return at
        return len(text)

    def encoded(self, text: str, spans: bool = True) -> tuple:
        """(ids, decoded text), and with ``spans`` (ids, decoded text, begins, ends)."""
        found, at = [], 0
        for k, part in enumerate(self.parts(text)):
            own = self.rest if k else self
            ids = own.ids([part])[0]
            found.append((np.array(ids, np.int32), own.decode([ids])[0]))
            if spans:
                found[-1] += tuple((x + at).astype(np.int32) for x in own.spans(part, ids))
                at += len(part.encode())
        ids, decoded, *ends = zip(*found)
        del found
        return _joined(ids), "".join(decoded), *map(_joined, ends)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [self.model.encode(t) for t in texts]  # given a list, the library makes a pool of threads each time

    def spans(self, text: str, ids) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of every piece in the text's UTF-8 bytes."""
        if self.spaces_only and "▁" not in text:  # the same as aligned(), from the pieces' sizes alone
            stop = np.cumsum(self.plain[np.asarray(ids, np.int64)]) - self.prefix
            if (int(stop[-1]) if len(stop) else 0) != len(text.encode()):
                raise ValueError("the pieces do not tile the text")
            return np.concatenate(([0], stop[:-1])) if len(stop) else stop, stop
        return self.aligned(text, ids)

    def aligned(self, text: str, ids) -> tuple[np.ndarray, np.ndarray]:
        """Spans through the normalised text's alignment, for any model and text."""
        _, begin, end = self.normalize(text)
        if self.by_id:
            size = self.sizes[np.asarray(ids, np.int64)]
        else:
            pieces = self.model.encode(text, out_type=str)
            size = np.array([1 if self.model.is_byte(i) else len(p.encode()) for i, p in zip(ids, pieces)], np.int64)
        stop = np.cumsum(size)
        if (int(stop[-1]) if len(stop) else 0) != len(begin):
            raise ValueError("the pieces do not tile the normalised text")
        return begin[stop - size], end[stop - 1]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.model.decode(i) for i in ids]


def _joined(arrays) -> np.ndarray:
    return arrays[0] if len(arrays) == 1 else np.concatenate(arrays)


def _encode(path: str, spans: bool):
    def run(batches):
        import pyarrow as pa

        encoder = Encoder(path)
        for whole in batches:
            for batch in text_slices(whole, 1, SLICE):
                each, decoded, *ends = zip(*(encoder.encoded(t, spans) for t in batch.column(1).to_pylist()))
                where = pa.array(np.cumsum([0] + [len(x) for x in each]).astype(np.int32))
                columns = [batch.column(0), pa.ListArray.from_arrays(where, pa.array(_joined(each))), pa.array(decoded, pa.string())]
                columns += [pa.ListArray.from_arrays(where, pa.array(_joined(x))) for x in ends]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded", "begins", "ends"][:len(columns)])
        release()
    return run


def encode_documents(df: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", spans: bool = True) -> DataFrame:
    """(doc_id, ids, decoded, begins, ends): one row per row of ``df``.

    ``ids`` has no begin or end ids; ``decoded`` is the library's text of them;
    ``begins`` and ``ends`` are the pieces' spans in bytes of the UTF-8 text (left
    out with ``spans=False``). A null text counts as empty and has no ids. Repeated
    rows are encoded each; an empty table gives an empty result. ``model_path`` must
    exist on every executor; the tokenizer is never trained here.
    """
    docs = documents(df, doc_id, text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>, decoded string" + (", begins array<int>, ends array<int>" if spans else "")
    return docs.mapInArrow(_encode(model_path, spans), schema)

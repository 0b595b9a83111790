"""k-mers, MinHash and minimizers of whole batches of sequences, as arrays.

What a read yields depends on that read alone, so operators call these on Arrow batches: nothing is
exploded or shuffled before its result. All sequences of a batch are one array of codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _table(order: str) -> np.ndarray:
    out = np.full(256, 4, np.uint8)
    for code, bases in enumerate(order.split()):
        for b in bases:
            out[ord(b)] = out[ord(b.lower())] = code
    return out


#: Codes of bases for sketches and for minimizers; 4 for any other letter.
SKETCH_CODES, NT4_CODES = _table("A T C G"), _table("A C G TU")


def codes(seqs: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all sequences one after the other, and where each starts (and the last one ends)."""
    raw = [(s or "").encode("ascii", "replace") for s in seqs]
    return table[np.frombuffer(b"".join(raw), np.uint8)], np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def rolling(code: np.ndarray, k: int) -> np.ndarray:
    """The k-mer that starts at each place, as a number of base 4: doubling, k up to 31."""
    power, out, done, size = code.astype(np.int64), None, 0, 1
    while done < k:
        if k & size:
            part = power[done : done + len(code) - k + 1]
            out = part if out is None else (out << (2 * size)) | part
            done += size
        if done < k:
            power = (power[:-size] << (2 * size)) | power[size:]
            size *= 2
    return out


def kmers(seqs: list[str | None], k: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, place, k-mer) of sequences of at least `least` bases, all of A, C, G and T."""
    code, starts = codes(seqs, SKETCH_CODES)
    sizes = np.diff(starts)
    n = np.where(sizes >= max(k, least), sizes - k + 1, 0)
    if not n.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = np.repeat(np.arange(len(seqs)), n)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return own, place, rolling(code, k)[starts[own] + place]


def hash64(x: np.ndarray, bits: int) -> np.ndarray:
    """The invertible hash of functions.sequences.hash64, over an array."""
    mask = np.int64((1 << bits) - 1)
    with np.errstate(over="ignore"):
        x = (~x + (x << 21)) & mask
        x = x ^ (x >> 24)
        x = (x + (x << 3) + (x << 8)) & mask
        x = x ^ (x >> 14)
        x = (x + (x << 2) + (x << 4)) & mask
        x = x ^ (x >> 28)
        return (x + (x << 31)) & mask


def _compressed(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one base as one base each: their codes and where they start (and the last one ends)."""
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], np.append(first, len(code))


def minimizers(seq: str | None, k: int, w: int, homopolymers: bool = False) -> tuple[np.ndarray, ...]:
    """(place, span, strand, hash) of a sequence's minimizers, in order.

    The least hash of each w consecutive k-mers, the last of equal ones, or of all where there are fewer; k-mers
    with other letters or equal to their reverse complement are left out. With homopolymers, runs of a base count
    as one, and a k-mer spans the runs' own lengths.
    """
    code = NT4_CODES[np.frombuffer((seq or "").encode("ascii", "replace"), np.uint8)]
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if len(code) < k:
        return none
    starts = np.arange(len(code) + 1)
    if homopolymers:
        code, starts = _compressed(code)
        if len(code) < k:
            return none
    clean = np.concatenate([[0], np.cumsum(code > 3)])
    fwd = rolling(code & 3, k)
    rev = rolling(3 - (code & 3)[::-1], k)[::-1]
    use = np.flatnonzero((clean[k:] == clean[:-k]) & (fwd != rev))
    if not len(use):
        return none
    h = hash64(np.minimum(fwd, rev)[use], 2 * k)
    if len(use) <= w:
        last = len(h) - 1 - int(h[::-1].argmin())
        at = np.array([last])
    else:
        view = np.lib.stride_tricks.sliding_window_view(h, w)
        at = np.unique(np.arange(len(view)) + w - 1 - view[:, ::-1].argmin(axis=1))
    picked = use[at]
    return starts[picked], starts[picked + k] - starts[picked], (rev < fwd)[picked].astype(np.int64), h[at]


def kmer_batches(k: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, place, kmer = kmers(batch.column("seq").to_pylist(), k, least)
            yield pa.RecordBatch.from_arrays([batch.column("read_id").take(pa.array(own)), pa.array(place.astype(np.int32)), pa.array(kmer)], ["read_id", "pos", "kmer"])

    return run


def kmer_totals(k: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, _, kmer = kmers(batch.column("seq").to_pylist(), k, least)
            size = batch.num_rows
            n = np.bincount(own, minlength=size)
            order = np.lexsort((kmer, own))
            o, x = own[order], kmer[order]
            new = np.ones(len(x), bool)
            new[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1])
            kinds = np.bincount(o[new], minlength=size)
            held = np.flatnonzero(n)
            total = np.add.reduceat(kmer, (np.cumsum(n) - n)[held]) if len(held) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("read_id").take(pa.array(held)), pa.array(n[held]), pa.array(kinds[held]), pa.array(total)], ["read_id", "n", "kinds", "total"])

    return run


def minhash_batches(k: int, seeds: list[int], least: int):
    """A read's least k-mer xor seed, for each seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, _, kmer = kmers(batch.column("seq").to_pylist(), k, least)
            n = np.bincount(own, minlength=batch.num_rows)
            held = np.flatnonzero(n)
            at = (np.cumsum(n) - n)[held]
            mins = np.array([np.minimum.reduceat(kmer ^ s, at) for s in seeds]).T.ravel() if len(held) else np.zeros(0, np.int64)
            ids = batch.column("read_id").take(pa.array(np.repeat(held, len(seeds))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(len(seeds), dtype=np.int32), len(held))), pa.array(mins)], ["read_id", "hash_idx", "min_hash"])

    return run


def sketch_batches(k: int, seeds: list[int], least: int, strands: int):
    """minhash_batches as a row a read: read_id, last, and a list of (hash_idx, min_hash) for each strand."""
    turned = str.maketrans("ACGT", "TGCA")

    def lists(seqs: list[str]) -> pa.Array:
        own, _, kmer = kmers(seqs, k, least)
        n = np.bincount(own, minlength=len(seqs))
        held = np.flatnonzero(n)
        at = (np.cumsum(n) - n)[held]
        mins = np.array([np.minimum.reduceat(kmer ^ s, at) for s in seeds]).T.ravel() if len(held) else np.zeros(0, np.int64)
        index = np.tile(np.arange(len(seeds), dtype=np.int32), len(held))
        rows = pa.StructArray.from_arrays([pa.array(index), pa.array(mins)], ["hash_idx", "min_hash"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * len(seeds))]).astype(np.int32)), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column("seq").to_pylist()
            made = [lists(seqs)] + [lists([s[::-1].translate(turned) for s in seqs])] * (strands > 1)
            yield pa.RecordBatch.from_arrays([batch.column("read_id"), batch.column("last"), *made], ["read_id", "last", "v", "turned"][: 2 + strands])

    return run


def minimizer_batches(k: int, w: int, homopolymers: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [minimizers(s, k, w, homopolymers) for s in batch.column("seq").to_pylist()]
            own = np.repeat(np.arange(batch.num_rows), [len(m[0]) for m in made])
            place, span, strand, h = (np.concatenate([m[c] for m in made]) if made else np.zeros(0, np.int64) for c in range(4))
            columns = [pa.array(place.astype(np.int32)), pa.array(strand.astype(np.int32)), pa.array(h), pa.array(span.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("read_id").take(pa.array(own)), *columns], ["read_id", "pos", "strand", "minimizer", "span"])

    return run

import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import merkle, token_files

WORDS = public_tokenizers.path("word_bpe_49k.json")


def in_order(docs):
    return sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))


def test_token_files_round_trip(spark, small, odd, empty, tmp_path):
    tokenizer = Tokenizer.from_file(WORDS)
    for k, docs in enumerate((spark.read.parquet(f"{small}/documents.parquet").repartition(3), odd)):
        folder = token_files.write_token_files(docs, f"file://{tmp_path}/{k}", WORDS)
        got = sorted(token_files.read_token_files(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
        coded = {}
        for r in docs.collect():
            ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
            coded.setdefault(r.doc_id, []).append(b"".join(i.to_bytes(4, "little") for i in ids))
        assert [r.doc_id for r in got] == [r.doc_id for r in in_order(docs)]
        at = 0
        for r in got:
            assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
            coded[r.doc_id].remove(bytes(r.ids))
            at += r.n_tokens
        manifest = json.loads((tmp_path / str(k) / "manifest.json").read_text())
        assert manifest["tokens"] == at and not list((tmp_path / str(k)).glob("*.attempt-*"))
        part = token_files.TokenPart(folder, manifest["parts"][0]["part"])
        assert part[0].dtype == np.uint16 and part[0][-1] == 2
    assert token_files.token_output(empty, WORDS).count() == 0


def test_leaves_rebuild_the_text():
    for text in ("", "one", "a b c d e f g h i j k\n\nl m\n" * 40, "word " * 500, "\n\n\n", "x\n \n\ny  z\t" * 9, "w" * 5000):
        paragraphs = [p for s in merkle.SECTION.findall(text) if s for p in merkle.PARAGRAPH.findall(s)]
        assert "".join(x for p in paragraphs for x in merkle.leaves_of(p)) == text
        assert merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(text)) == 1


def test_edits_are_located():
    text = "\n\n".join(f"section {i} line one\nline two of section {i}\nline three {i} {i}" for i in range(5))
    assert merkle.edits(merkle.fingerprint(text), merkle.fingerprint(text.replace("line two of section 3", "line TWO of section 3"))) == [(3, 1)]
    assert merkle.edits(merkle.fingerprint(text), merkle.fingerprint(text)) == []


def plain_likeness(a, b):
    """Share of code points of leaves in common, of the longer text's."""
    if a.split("/")[0] == b.split("/")[0]:
        return 1.0
    sizes = []
    for print_ in (a, b):
        sizes.append({})
        for leaf in re.findall(r"[0-9a-f]+", print_.split("/", 1)[1]):
            sizes[-1][leaf] = sizes[-1].get(leaf, 0) + 1
    points = lambda leaf: int(leaf[10:], 16)
    common = sum(points(x) * min(n, sizes[1].get(x, 0)) for x, n in sizes[0].items())
    return common / max(1, *(sum(points(x) * n for x, n in s.items()) for s in sizes))


def plain_print(text):
    """Root, leaves and nodes by hand, from the sections that the text's blank lines make."""
    def digest(data, size):
        return hashlib.blake2b(data, digest_size=size).digest()

    told, nodes = [], b""
    for section in [x for x in re.findall(r"(?s).*?(?:\n[ \t]*\n+|\Z)", text) if x]:
        paragraphs, below = [], b""
        for paragraph in re.findall(r"[^\n]*\n+|[^\n]+\Z", section):
            words = re.findall(r"\S*\s+|\S+\Z", paragraph)
            if len(words) > 8:
                ends, last = [], 0
                for i, word in enumerate(words, 1):
                    if xxhash.xxh32(word.encode()).intdigest() % 8 == 0 or i - last > 32 or i == len(words):
                        ends.append((last, i))
                        last = i
            else:
                ends = [(i, i + 2) for i in range(0, len(words), 2)]
            leaves = ["".join(words[a:b]) for a, b in ends]
            names = [digest(x.encode("utf-8", "replace"), 5).hex() for x in leaves]
            paragraphs.append(",".join(f"{n}{len(x):x}" for n, x in zip(names, leaves, strict=True)))
            below += digest(b"p" + "".join(names).encode(), 16)
        told.append(";".join(paragraphs))
        nodes += digest(b"s" + below, 16)
    return digest(nodes + hashlib.sha256(text.encode("utf-8", "replace")).digest(), 16).hex() + "/" + "|".join(told)


def test_compared_against_brute_force(spark, small, odd, empty):
    for docs, n in ((spark.read.parquet(f"{small}/documents.parquet").repartition(5), 30), (odd, 3), (odd, 4000)):
        got = merkle.compared(docs, rows_per_range=n).collect()
        rows = in_order(docs)
        assert sorted((r.doc_id, r.n_chars) for r in got if r.doc_id is not None) == sorted((r.doc_id, len(r.text or "")) for r in rows if r.doc_id is not None)
        if docs is odd:
            continue
        by_id = {r.doc_id: r for r in got}
        for a, b in zip(rows, rows[1:] + rows[:1], strict=True):
            k = len(a.text) // 4
            changed = a.text[: len(a.text) - k] + b.text[:k]
            r = by_id[a.doc_id]
            assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
            assert r.fingerprint == plain_print(a.text) and r.edited_fingerprint == plain_print(changed)
            assert abs(r.near_next - plain_likeness(r.fingerprint, by_id[b.doc_id].fingerprint)) < 1e-12 and abs(r.near_edited - plain_likeness(r.fingerprint, r.edited_fingerprint)) < 1e-12
        far = [r for r in got if r.n_chars > 200]
        assert sum(r.near_edited for r in far) / len(far) > 0.65
    assert merkle.compared(empty).count() == 0


def test_one_id_for_all_rows_is_cut_into_ranges(spark):
    """Equal and null ids: each row's next one is that of the order by id and text hash, over many ranges."""
    for ids in ([None] * 300, [7] * 300, [None] * 100 + [7] * 100 + list(range(100))):
        docs = spark.createDataFrame([(i, f"text {k} " + "w " * (k % 40)) for k, i in enumerate(ids)], "doc_id long, text string").repartition(4)
        order = sorted(docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
        want = Counter()
        for a, b in zip(order, order[1:] + order[:1], strict=True):
            k = len(a.text) // 4
            want[a.doc_id, hashlib.sha256((a.text[: len(a.text) - k] + b.text[:k]).encode()).hexdigest(), plain_print(a.text)] += 1
        table = merkle.compared(docs, rows_per_range=20)
        got = Counter((r.doc_id, r.edited_sha256, r.fingerprint) for r in table.collect())
        assert got == want and table.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 60


def test_words_ends_are_merged_as_by_the_library():
    """Pieces whose last byte has an id of its own, merged by ranks behind an end mark."""
    import public_tokenizers
    from tidemark.llm.tokens import Encoder

    coder = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert coder.ended
    for word in "a Z zebra Unbelievably's straße İstanbul ÿ x1y22 don't ªº é­é ... a...b \n\tmixed,Case,&&&### Tiontionble 9999".split(" ") + ["q" * 500, "ab" * 40]:
        assert coder.chunk(word, {}, " ") == coder.plain(word), word

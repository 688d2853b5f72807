"""Wrapped FASTA files written here, read back by byte ranges."""

import random

import pytest

from somaspark.sources import reference as R


@pytest.fixture(scope="module", params=["\n", "\r\n"])
def made(request, tmp_path_factory):
    r, end = random.Random(1), request.param
    seqs = {name: "".join(r.choices("ACGTacgtN", k=n)) for name, n in (("chr1", 1000), ("chr2", 64), ("one", 1), ("chr3", 777))}
    widths = {"chr1": 60, "chr2": 64, "one": 5, "chr3": 7}
    path, text, index = f"{tmp_path_factory.mktemp('fa')}/a.fa", "", []
    for name, s in seqs.items():
        text += f">{name} some words{end}"
        index.append((name, len(s), len(text), widths[name], widths[name] + len(end)))
        text += "".join(s[i : i + widths[name]] + end for i in range(0, len(s), widths[name]))
    with open(path, "w", newline="") as f:
        f.write(text)
    with open(f"{path}.fai", "w") as f:
        f.writelines("\t".join(map(str, x)) + "\n" for x in index)
    return path, seqs


@pytest.mark.parametrize("chunk, overlap, stretch", [(64, 0, 1 << 18), (64, 4, 128), (50, 7, 333), (1, 0, 100)])
def test_chunks(spark, made, chunk, overlap, stretch):
    path, seqs = made
    got = {(x.contig, x.start): x.seq for x in R.read_reference(spark, path, chunk=chunk, overlap=overlap, stretch=stretch).collect()}
    assert got == {(c, i): s[i : i + chunk + overlap].upper() for c, s in seqs.items() for i in range(0, len(s), chunk)}


def test_contigs_and_fetch(spark, made):
    path, seqs = made
    assert [(x.ord, x.contig, x.length) for x in R.read_fai(spark, f"{path}.fai").orderBy("ord").collect()] == [(i, c, len(s)) for i, (c, s) in enumerate(seqs.items(), 1)]
    assert {x.contig for x in R.read_reference(spark, path, contigs=["chr2", "one"]).collect()} == {"chr2", "one"}
    with pytest.raises(Exception, match="unknown contig: chr9"):
        R.read_reference(spark, path, contigs=["chr2", "chr9"]).collect()
    reference = R.read_reference(spark, path, chunk=16, overlap=3)
    r = random.Random(2)
    rows = [(i, c, s, s + r.randrange(60)) for i in range(80) for c in [r.choice(list(seqs))] for s in [r.randrange(len(seqs[c]))]]
    got = {x.id: x.seq for x in R.fetch(spark.createDataFrame(rows, "id int, contig string, s int, e int"), reference, 16).collect()}
    assert got == {i: seqs[c][s:e].upper() for i, c, s, e in rows}


def test_an_index_that_does_not_fit_is_an_error(spark, made, tmp_path):
    path, _ = made
    (tmp_path / "a.fai").write_text("chr1\t100000\t5\t60\t61\n")
    with pytest.raises(Exception, match="does not fit"):
        R.read_reference(spark, path, index=f"{tmp_path}/a.fai").collect()


def test_aligned_sequences(spark, tmp_path):
    (tmp_path / "msa.fa").write_text(">0 ref\nAC-GT\nA--\n>1\n-CCGTA-G\n>2\n\n")
    assert {(x.name, x.seq) for x in R.read_aligned(spark, f"{tmp_path}/msa.fa").collect()} == {("0", "AC-GTA--"), ("1", "-CCGTA-G"), ("2", "")}

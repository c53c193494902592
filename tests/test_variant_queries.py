import hashlib
from collections import Counter

from strandlake.plans.variant_queries import fasta_info, kmer_jaccard


def test_long_sequences_are_not_cut(spark, tmp_path):
    seq = "A" * 1_000_000 + "C" * 100
    spark.createDataFrame([(1, seq)], "call_id long, seq string").write.parquet(f"{tmp_path}/variant_calls.parquet")
    a, b = (Counter(t[i : i + 9] for i in range(len(t) - 8)) for t in (seq, seq[4:] + "ACGTACGTACGT"))
    assert abs(kmer_jaccard(spark, str(tmp_path)).first()[1] - (a & b).total() / (a | b).total()) < 1e-9
    name = "ACGT" * 5000
    spark.createDataFrame([(1, name)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    assert [tuple(r) for r in fasta_info(spark, str(tmp_path)).collect()] == [("p1", 20000, hashlib.md5(name.encode()).hexdigest())]

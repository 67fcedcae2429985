"""Column expressions (no UDFs): DNA, arrays, numbers, text."""

from seqedge.functions.arrays import (array_sum, class_distribution, pad_to, positive_probability,
                                      remove_padding, softmax)
from seqedge.functions.dna import dna_from_key, kmer_set, kmers, reverse_complement, slice_closed
from seqedge.functions.numeric import binarize, clip, logit, nan_to_null, sigmoid
from seqedge.functions.text import gtf_attribute, run_name, split_ids

__all__ = [
    "array_sum", "class_distribution", "pad_to", "positive_probability", "remove_padding", "softmax",
    "dna_from_key", "kmer_set", "kmers", "reverse_complement", "slice_closed",
    "binarize", "clip", "logit", "nan_to_null", "sigmoid",
    "gtf_attribute", "run_name", "split_ids",
]

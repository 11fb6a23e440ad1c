"""Operators for large text-corpus pipelines (training-data preparation).

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries only where it is present.  Modules, one per operator:

===========  ==================================================================
secrets      sliding-window entropy secret scan (DataFrame functions only)
lm           interpolated modified Kneser-Ney model in memory-mapped hash arrays
bpe          byte-level BPE encode / decode by monoid tree reduction
simhash      SimHash near-duplicate components by tiled exact comparison
tokencount   exact token count at every prefix by dynamic programming
pii          format-preserving Feistel pseudonyms (DataFrame functions only)
media        content-defined chunk store with verified reconstruction
toxicity     Levenshtein automata over a learnt lexicon trie
mixing       multivariate-hypergeometric splitting tree (DataFrame only)
topk         exact top-k inner product search with block bounds
===========  ==================================================================
"""

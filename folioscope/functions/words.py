"""Word lists and limits that results depend on."""

from __future__ import annotations

# Words without meaning for keyword search.
STOP_WORDS = (
    "a an and are as at be but by can could do does for from had has have how i if in into is it its me my of on or our "
    "should so that the their them then there these they this to us was we were what when where which who why will with "
    "would you your"
).split()
# Words that say nothing about a topic by themselves.
VAGUE_WORDS = (
    "a an the this that these those it its them they their he she him her here there what which who how when where why "
    "whether if any anything about beyond than of to in on for and or with by from at as is are be was were do does "
    "includes include included more other else such"
).split()
# Limits and weights.
MAX_CHUNK_CHARS = 1000
TOP_K = 12
RARE_MAX_PASSAGES = 3
CLOSEST_SECTIONS = 3
MAX_GAP_QUERIES = 3
MAX_EXTRA_PASSAGES = 8
RESTATED_SHARE = 0.75
RESTATED_WORDS = 4
DOLLARS_PER_MILLION = {"input": 2, "output": 10}
NOT_COVERED = "NOT_COVERED"
# BM25+ term weighting with smoothed idf; parameters of this library.
BM25 = {"k": 1.2, "b": 0.7, "d": 0.5, "title_boost": 2.0}

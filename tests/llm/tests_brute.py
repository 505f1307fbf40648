"""The pipeline's stages by brute force, for a corpus without toxic documents."""

from test_filters import folded
from test_formats import cut
from test_near_dup import brute


def pipeline_rows(corpus, leaked):
    classes = brute(corpus)
    kept = [(i, t) for i, t in corpus if classes[i] == i]
    texts = {}
    for i, (w, gone) in cut(kept).items():
        texts[i] = None if dict(kept)[i] is None else [x for x, g in zip(w, gone, strict=True) if not g]
    b = folded(leaked)
    windows = {tuple(b[k : k + 10]) for k in range(max(1, len(b) - 9))}
    clean = {}
    for i, w in texts.items():
        f = folded(" ".join(w or []))
        if not any(tuple(f[k : k + 10]) in windows for k in range(len(f) - 9)):
            clean[i] = w
    return clean

import numpy as np


def arrays_of(df):
    """Pixel DataFrame back to {image_id: array (h, w, 3)}; checks that every place is filled once."""
    rows = df.select("image_id", "w", "h", "x", "y", "b", "g", "r").collect()
    out, seen = {}, {}
    for i, w, h, x, y, b, g, r in rows:
        a = out.setdefault(i, np.zeros((h, w, 3), int))
        s = seen.setdefault(i, np.zeros((h, w), int))
        a[y, x] = (b, g, r)
        s[y, x] += 1
    for i, s in seen.items():
        assert (s == 1).all(), f"image {i}: places filled {s.min()}..{s.max()} times"
    return out


def random_images(sizes, seed=1):
    rng = np.random.default_rng(seed)
    return {i: rng.integers(0, 256, (h, w, 3)) for i, (w, h) in enumerate(sizes)}


def fits(actual, wanted):
    assert actual.keys() == wanted.keys()
    for i in wanted:
        assert actual[i].shape == wanted[i].shape, i
        assert (actual[i] == wanted[i]).all(), f"image {i}\n{actual[i]}\n{wanted[i]}"

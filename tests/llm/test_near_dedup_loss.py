"""How often a similar pair is lost: by not meeting in a bucket, and by the signature filter before verification."""

import numpy as np

from cataloom.llm import minhash_dedup as md


def lost(j, least):
    """(no band agrees, a band agrees but fewer than a share of least of the samples) of pairs with similarity j."""
    from math import comb

    terms = [comb(md.ROWS, k) * j**k * (1 - j) ** (md.ROWS - k) for k in range(md.ROWS + 1)]
    whole, none = np.ones(1), np.ones(1)
    for _ in range(md.BANDS):
        whole, none = np.convolve(whole, terms), np.convolve(none, [*terms[:-1], 0.0])
    few = np.arange(len(whole)) < least * md.SAMPLES
    return none.sum(), (whole - none)[few].sum()


def test_loss_at_the_threshold_and_at_the_hub():
    apart, filtered = lost(md.THRESHOLD, md.SURE)
    assert apart < 3e-4 and filtered < 1e-6
    assert lost(md.LOW, md.SURE_LOW)[1] < 1e-6
    assert lost(0.9, md.SURE)[0] < 1e-7


def test_signatures_of_pairs_at_the_threshold():
    """Sets of 400 of which 356 are shared: a similarity of 0.80."""
    r, sampler = np.random.default_rng(4), md.Sampler()
    agree, met = [], 0
    for _ in range(300):
        names = r.integers(0, 2**63, 444).astype(np.uint64)
        a, b = np.sort(names[:400]), np.sort(np.concatenate((names[:356], names[400:])))
        sig = sampler.signatures(np.concatenate((a, b)), np.ones(800), np.array([0, 400, 800]))
        keys = md.band_keys(sig)
        met += bool((keys[0] == keys[1]).any())
        agree.append((sig[0] == sig[1]).mean())
    assert met >= 298 and abs(np.mean(agree) - 356 / 444) < 0.01 and min(agree) >= md.SURE

"""Near copies inside a large family of texts on one template, whose members are not near copies of each other."""

from turnstone.llm.near_copies import without_near_copies


def golay(i):
    """A word of the Golay code: 24 bits, any two words differ in eight at least."""
    word = 0
    for k in range(12):
        if i >> k & 1:
            word ^= 0xC75 << k
    return word << 1 | word.bit_count() & 1


def on_template(code):
    """200 words; each bit of the code chooses one, and with it five of the 196 shingles."""
    words = [f"w{k}" for k in range(200)]
    for k in range(24):
        words[5 + 8 * k] += f"is{code >> k & 1}"
    return " ".join(words)


def test_pairs_in_crowded_buckets_are_found(frame):
    """Family texts are at 156 / 236 at most, copies at 181 / 211; every shingle is common, so no bucket is a pair's own."""
    codes = [golay(i) for i in range(800)]
    copies = [codes[i] ^ 0b1000000010000000100 for i in range(0, 800, 20)]  # 5 bits at least from all others
    rows = list(enumerate(map(on_template, [*codes, *copies])))
    kept = sorted(r.doc_id for r in without_near_copies(frame(rows)).collect())
    assert kept == list(range(800))

"""What several tests compute plainly."""


def words(text):
    return (text or "").encode().lower().split()


def union_find(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_groups(corpus, n, percent):
    sets = {}
    for i, text, *_ in corpus:
        w = words(text)
        sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    low = union_find(pairs, sets)
    return {i: (len(s), low[i]) for i, s in sets.items()}

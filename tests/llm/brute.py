"""Plain Python versions of the operators' contracts, for small inputs."""

import hashlib
import re
import zlib


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))


def shingles(text, size=5):
    words = space_words(fold(text))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def near_duplicates(docs):
    """docs: (doc_id, text) with distinct ids; returns doc_id -> (n, component, kept)."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    shared = {}
    for ids in where.values():
        for a in range(len(ids)):
            for b in range(a):
                shared[ids[b], ids[a]] = shared.get((ids[b], ids[a]), 0) + 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            one, two = sorted((top(a), top(b)))
            parent[two] = one
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def contamination(text, items, window=10):
    """(n_words, n_hit, sorted item ids as strings)."""
    words = alnum_words(text)
    hit, found = set(), set()
    for item, item_text in items:
        its = alnum_words(item_text)
        if not its:
            continue
        size = min(window, len(its))
        wanted = {tuple(its[k : k + size]) for k in range(len(its) - size + 1)}
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in wanted:
                hit.update(range(k, k + size))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def quality_numbers(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = space_words(text)
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if space_words(line):
            dups += line in seen
            seen.add(line)
    where = {}
    for k in range(len(words) - 4):
        where.setdefault(tuple(words[k : k + 5]), []).append(k)
    hit = {k + d for ks in where.values() if len(ks) > 1 for k in ks for d in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(hit)


def base_secrets(text):
    """Spans (start, order, end, kind) of the base kinds, straight from the contract's expressions."""
    rules = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    return sorted((m.start(), k, m.end(), kind) for k, (kind, rule, good) in enumerate(rules) for m in rule.finditer(text or "") if good(m))


def manifest(docs: list[tuple]) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each (doc_id, source, lang, n_chars, text)."""
    sha = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    leaf = lambda row: sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def tree(row):
        """Siblings of each node, and the top."""
        at, ways = list(range(len(row))), [[] for _ in row]
        while len(row) > 1:
            for k, i in enumerate(at):
                first = i - i % 3
                ways[k].append((row[first:i], row[i + 1 : first + 3]))
                at[k] = i // 3
            row = [sha(*row[k : k + 3]) for k in range(0, len(row), 3)]
        return ways, row[0]

    sources = sorted({d[1] for d in docs}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((d for d in docs if d[1] == s), key=lambda d: (d[0], leaf(d))) for s in sources]
    trees = [tree([leaf(d) for d in g]) for g in groups]
    upper, root = tree([t[1] for t in trees])
    out = []
    for group, (ways, subroot), above in zip(groups, trees, upper):
        for d, way in zip(group, ways):
            text = d[4] and d[4].replace("\n", "") if zlib.crc32(str(d[0]).encode()) % 2 == 0 else d[4]
            digest = leaf((*d[:4], text))
            for left, right in way + above:
                digest = sha(*left, digest, *right)
            proof = sha(*(x for left, right in way + above for x in left + right))
            out.append((d[0], leaf(d), subroot, root, proof, digest, digest == root))
    return out


def turn_key(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def rebuilt(turns: list[tuple]) -> dict:
    """conv_id: [(role, text)] after the first h turns of conversation c - c % 5 (truncated) took their place."""
    own = {}
    for c, turn, role, text in turns:
        own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + said[h:]
    return out


def prefix_trie(convs: dict) -> list[tuple]:
    members = {}
    for c, said in convs.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(c)
    children, out = {}, []
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        leaves, saved = (0, 0) if children.get(node) else (1, 0)
        if node:
            saved += (len(members[node]) - 1) * len((node[-1][1] or "").encode())
        for child in children.get(node, []):
            more = below(child)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    for node, own in members.items():
        leaves, saved = below(node)
        ends = ",".join(str(c) for c in sorted(c for c in own if len(convs[c]) == len(node)))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children.get(node, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def without_repeats(docs: list[tuple], window: int = 13) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept) of each (doc_id, text); a null id is larger than any other."""
    rank = lambda i: float("inf") if i is None else i
    said = [(i, space_words(t)) for i, t in docs]
    least = {}
    for i, words in said:
        for k in range(len(words) - window + 1):
            gram = tuple(words[k : k + window])
            least[gram] = min(least.get(gram, float("inf")), rank(i))
    out = []
    for i, words in said:
        gone = {p for k in range(len(words) - window + 1) if least[tuple(words[k : k + window])] < rank(i) for p in range(k, k + window)}
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out

"""Token alignment of small sets of texts, each encoded whole, by the plainest loops."""

import collections
import hashlib

import sentencepiece
from tokenizers import Tokenizer


def byte_alphabet():
    """Character of a byte-level vocabulary to byte."""
    own = {chr(b): b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    rest = [b for b in range(256) if b not in own.values()]
    return own | {chr(256 + k): b for k, b in enumerate(rest)}


def brute(rows, byte_model, piece_model):
    """{doc_id: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)}; ids must differ."""
    a, b, table = Tokenizer.from_file(byte_model), sentencepiece.SentencePieceProcessor(model_file=piece_model), byte_alphabet()
    a.encode_special_tokens = True
    linked, shape = {}, {}
    for doc_id, text in rows:
        linked[doc_id], shape[doc_id] = [], (0, 0, 0, "")
        if not text:
            continue
        raw = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            continue
        groups, i, j, at_a, at_b, own_a, own_b = [], 0, 0, 0, 0, [], []
        while i < len(ids_a) or j < len(ids_b):
            if at_a <= at_b:
                at_a += len(bytes_a[i])
                own_a.append(ids_a[i])
                i += 1
            else:
                at_b += len(bytes_b[j])
                own_b.append(ids_b[j])
                j += 1
            if at_a == at_b:
                groups.append((own_a, own_b))
                own_a, own_b = [], []
        linked[doc_id] = [(x, y) for p, q in groups for x in p for y in q]
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        shape[doc_id] = (len(ids_a), len(ids_b), len(groups), hashlib.sha256(said.encode()).hexdigest())
    count = collections.Counter(p for pairs in linked.values() for p in set(pairs))
    most = collections.defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return {d: (*shape[d][:3], len(p), sum(count[q] == most[q[0]] for q in p), sum(count[q] for q in p), shape[d][3]) for d, p in linked.items()}

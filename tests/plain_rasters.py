"""The raster steps over one small image in plain loops, as a second opinion on the DataFrame ones."""

import math

import numpy as np


def window(img, y, x, k):
    return img[max(0, y - k) : y + k + 1, max(0, x - k) : x + k + 1]


def each(img, f):
    return np.array([[f(y, x) for x in range(img.shape[1])] for y in range(img.shape[0])])


def gaussian(img, k, sigma):
    def at(y, x):
        top = bottom = 0.0
        for j in range(max(0, y - k), min(img.shape[0], y + k + 1)):
            for i in range(max(0, x - k), min(img.shape[1], x + k + 1)):
                w = math.exp(-((j - y) ** 2) / (2 * sigma**2)) * math.exp(-((i - x) ** 2) / (2 * sigma**2))
                top, bottom = top + w * img[j, i], bottom + w
        return top / bottom

    return each(img, at)


def disc(img, k, pick):
    inside = lambda j, i: 0 <= j < img.shape[0] and 0 <= i < img.shape[1]
    around = [(j, i) for j in range(-k, k + 1) for i in range(-k, k + 1) if j * j + i * i <= k * k]
    return each(img, lambda y, x: pick(img[y + j, x + i] for j, i in around if inside(y + j, x + i)))


def tophat(img, k):
    low = each(img, lambda y, x: window(img, y, x, k).min())
    return img - each(low, lambda y, x: window(low, y, x, k).max())


def clahe(img, clip=2.0, grid=8):
    h, w = img.shape
    tw, th = math.ceil(w / grid), math.ceil(h / grid)
    tables = {}
    for ty in range(math.ceil(h / th)):
        for tx in range(math.ceil(w / tw)):
            part = img[ty * th : (ty + 1) * th, tx * tw : (tx + 1) * tw]
            hist = np.bincount(part.ravel(), minlength=256)
            limit = max(1, int(clip * part.size / 256))
            excess = int(np.maximum(0, hist - limit).sum())
            hist = np.minimum(hist, limit) + excess // 256 + (np.arange(256) < excess % 256)
            tables[ty, tx] = np.floor(np.cumsum(hist) * 255 / part.size + 0.5)
    last_y, last_x = math.ceil(h / th) - 1, math.ceil(w / tw) - 1

    def at(y, x):
        fy, fx, total = (y + 0.5) / th - 0.5, (x + 0.5) / tw - 0.5, 0.0
        for dy in (0, 1):
            for dx in (0, 1):
                wy, wx = (fy - math.floor(fy), fx - math.floor(fx))
                ty, tx = min(last_y, max(0, math.floor(fy) + dy)), min(last_x, max(0, math.floor(fx) + dx))
                total += (wy if dy else 1 - wy) * (wx if dx else 1 - wx) * tables[ty, tx][img[y, x]]
        return math.floor(round(total, 6) + 0.5)

    return each(img, at).astype(int)


def otsu(img):
    best = None
    for t in sorted(set(img.ravel().tolist())):
        low, high = img[img <= t], img[img > t]
        q = round(len(low) * len(high) * (low.mean() - high.mean()) ** 2, 3) if len(high) else 0.0
        if best is None or q > best[0]:
            best = q, t
    return best[1]


def components(mask, reach=8):
    """Lists of (y, x) of the components, by their first pixel."""
    left, out = {(y, x) for y, x in zip(*np.nonzero(mask))}, []
    while left:
        todo, own = [min(left)], []
        left.discard(todo[0])
        while todo:
            y, x = todo.pop()
            own.append((y, x))
            for j, i in ((j, i) for j in (-1, 0, 1) for i in (-1, 0, 1) if reach == 8 or not (i and j)):
                if (y + j, x + i) in left:
                    left.discard((y + j, x + i))
                    todo.append((y + j, x + i))
        out.append(sorted(own))
    return sorted(out)


def drawn(parts, shape):
    mask = np.zeros(shape, int)
    for part in parts:
        for y, x in part:
            mask[y, x] = 1
    return mask


def cleaned(mask, min_size, close, times=1):
    """Components of a mask without small objects and with gaps closed."""
    m = drawn([c for c in components(mask) if len(c) >= min_size], mask.shape)
    for pick in [max] * times + [min] * times:
        m = disc(m, close, pick)
    return components(m)


def hull_area(part):
    points = sorted({(x + i, y + j) for y, x in part for j in (0, 1) for i in (0, 1)})

    def half(points):
        chain = []
        for p in points:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        return chain[:-1]

    ring = half(points) + half(points[::-1])
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


def props(part):
    """area, bbox (x1, y1, x2, y2), major, minor, eccentricity, solidity of a component."""
    y, x = np.array(part, float).T
    cov = np.cov(np.stack([x, y]), bias=True)
    l2, l1 = np.linalg.eigvalsh(cov)
    l1, l2 = max(0.0, l1), l2 if l2 >= 1e-9 else 0.0
    box = int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1
    return {"area": len(part), "box": box, "major": 4 * math.sqrt(l1), "minor": 4 * math.sqrt(l2), "eccentricity": math.sqrt(1 - l2 / l1) if l1 > 0 else 0.0, "solidity": len(part) / hull_area(part)}


def scaled(box, factor, w, h):
    x, y, bw, bh = box[0], box[1], box[2] - box[0], box[3] - box[1]
    sw, sh = int(bw * factor), int(bh * factor)
    sx, sy = max(0, int(x + bw / 2 - sw / 2)), max(0, int(y + bh / 2 - sh / 2))
    return sx, sy, sx + min(sw, w - sx), sy + min(sh, h - sy)


def iou(a, b):
    common = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common
    return common / union if union else 0.0


def suppressed(rows, t=0.3):
    """Rows (box, conf, ...) that greedy suppression keeps, strongest first, the earlier one on ties."""
    kept = []
    for r in sorted(rows, key=lambda r: -r[1]):
        if all(iou(r[0], k[0]) <= t for k in kept):
            kept.append(r)
    return kept


def circle(w, h, shrink):
    return w // 2, h // 2, max(10, int(min(w, h) * 0.48) - shrink)


def in_circle(mask, shrink):
    h, w = mask.shape
    cx, cy, r = circle(w, h, shrink)
    return mask & each(mask, lambda y, x: (x - cx) ** 2 + (y - cy) ** 2 <= r * r)


def edges(img, low, high, k=2, sigma=1.1):
    soft = gaussian(img, k, sigma)
    h, w = img.shape
    m, turn = np.zeros((h, w)), np.zeros((h, w), int)
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            p = soft[y - 1 : y + 2, x - 1 : x + 2]
            gx = (p[:, 2] - p[:, 0]) @ [1, 2, 1]
            gy = (p[2] - p[0]) @ [1, 2, 1]
            m[y, x] = math.hypot(gx, gy)
            turn[y, x] = math.floor(math.degrees(math.atan2(gy, gx)) / 45 + 0.5) % 4
    step = {0: (1, 0), 1: (1, 1), 2: (0, 1), 3: (1, -1)}
    thin = np.zeros((h, w), bool)
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            dx, dy = step[turn[y, x]]
            thin[y, x] = m[y, x] > low and m[y, x] >= max(m[y + dy, x + dx], m[y - dy, x - dx])
    kept = drawn([c for c in components(thin) if any(m[y, x] > high for y, x in c)], (h, w))
    return each(kept, lambda y, x: window(kept, y, x, 1).max()).astype(bool)


def blobs(img, sigmas, least=0.01, most=0.5):
    """(x, y, sigma, response) of scale-space maxima without those that a larger one covers."""
    h, w = img.shape
    space = np.full((len(sigmas), h, w), -np.inf)
    for s, sigma in enumerate(sigmas):
        soft = gaussian(img, int(3 * sigma + 0.5), sigma)
        space[s, 1:-1, 1:-1] = -(sigma**2) * (soft[1:-1, 2:] + soft[1:-1, :-2] + soft[2:, 1:-1] + soft[:-2, 1:-1] - 4 * soft[1:-1, 1:-1])
    found = []
    for s in range(len(sigmas)):
        for y in range(1, h - 1):
            for x in range(1, w - 1):
                near = space[max(0, s - 1) : s + 2, y - 1 : y + 2, x - 1 : x + 2]
                if space[s, y, x] > least and space[s, y, x] >= near.max():
                    found.append((s, y, x, space[s, y, x], sigmas[s] * math.sqrt(2)))
    gone = set()
    for i, (_, y, x, v, r) in enumerate(found):
        for j, (_, q, p, u, o) in enumerate(found[:i]):
            d, a, b = math.hypot(x - p, y - q), max(r, o), min(r, o)
            if d <= a - b:
                lens = math.pi * b * b
            elif d >= a + b:
                lens = 0.0
            else:
                lens = a * a * math.acos((d * d + a * a - b * b) / (2 * d * a)) + b * b * math.acos((d * d + b * b - a * a) / (2 * d * b)) - math.sqrt((-d + a + b) * (d + a - b) * (d - a + b) * (d + a + b)) / 2
            if lens / (math.pi * b * b) > most:
                gone.add(i if o > r or (o == r and u >= v) else j)
    return [(x, y, sigmas[s], v) for k, (s, y, x, v, _) in enumerate(found) if k not in gone]


def perimeter(part):
    """Weights by the codes of the border pixels: 2 for each neighbour on the border by a side, 10 by a corner."""
    inside = set(part)
    border = {(y, x) for y, x in part if not all(n in inside for n in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)))}
    total = 0.0
    for y, x in border:
        code = 1 + sum(10 if i and j else 2 for j in (-1, 0, 1) for i in (-1, 0, 1) if (i or j) and (y + j, x + i) in border)
        total += 1 if code in (5, 7, 15, 17, 25, 27) else math.sqrt(2) if code in (21, 33) else (1 + math.sqrt(2)) / 2 if code in (13, 23) else 0
    return total

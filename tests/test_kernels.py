import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from kawara.operators import kernels as k

L_SHAPE = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)]


def area(ring, triangles):
    p = np.array(ring, float)
    return sum(abs((p[b] - p[a])[0] * (p[c] - p[a])[1] - (p[b] - p[a])[1] * (p[c] - p[a])[0]) / 2 for a, b, c in triangles)


def test_triangulations_cover_the_ring():
    for cut in (k.ear_clipped, k.triangulated):
        found = cut(L_SHAPE)
        assert len(found) == 4 and area(L_SHAPE, found) == 12


def test_face_checks():
    square = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)]
    assert k.face_checks(square, 0.03, 20)[1:] == (0, True, False, False, 0, 0)
    assert k.face_checks([*square[:2], (1, 1, 0.1), square[3]], 0.03, 20)[4]
    assert k.face_checks([(0, 0, 0), (2, 2, 0), (2, 0, 0), (0, 1, 0)], 0.03, 20)[5] == 1
    assert k.face_checks([*square, (0, 1, 0.001)], 0.03, 20)[1] == 1
    assert k.face_checks([(0, 0, 0), (1, 0, 0), (2, 0, 0)], 0.03, 20)[3]
    assert not k.face_checks([(0, 0, 0), (0, 0, 0), (2, 0, 0)], 0.03, 20)[2]


@given(st.lists(st.tuples(st.integers(0, 5).map(str), st.integers(1, 40), st.integers(1, 40)), max_size=30))
def test_atlas(rects):
    placed = k.bottom_left_packed(rects, 64)
    for i, p in enumerate(placed):
        if p:
            assert p[1] + rects[i][1] <= 64 and p[2] + rects[i][2] <= 64
            for j in range(i):
                if q := placed[j]:
                    assert p[0] != q[0] or not (p[1] < q[1] + rects[j][1] and q[1] < p[1] + rects[i][1] and p[2] < q[2] + rects[j][2] and q[2] < p[2] + rects[i][2])
                    assert rects[i][0] != rects[j][0] or p[0] == q[0]


def test_small_kernels():
    assert k.seed_merged([0, 1.5, 3, 2.5, 10], 2.0) == [0, 0, 1, 1, 2]
    assert sorted(map(len, k.planar_faces([(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2)]))) == [3, 3, 4]
    assert k.edge_rings([(1, 2), (3, 1), (2, 3), (7, 8)]) == [[1, 2, 3]]
    assert k.mask_components(np.array([[1, 0, 1], [1, 0, 0]], bool)).max() == 2
    assert len(k.simplified([(0, 0), (1, 0), (2, 0), (2, 2), (0, 2)])) == 4
    square = np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float)
    m = k.homography(square, square * 2 + 1)
    assert np.allclose(m @ [0.5, 0.5, 1] / (m @ [0.5, 0.5, 1])[2], [2, 2, 1])
    data = np.zeros((4, 4, 2))
    data[..., 1] = 1
    data[1, 1] = (3, 0)
    assert k.grid_energy(data, k.local_labels(data, 5.0), 5.0) <= k.grid_energy(data, data.argmin(2), 5.0)
    assert k.page_size(1, 1, 3, 2) == (4, 2)
    assert len(set(k.mean_shift(np.array([0, 0.1, 5, 5.1]), np.ones(4), 0.5))) == 2

import pytest

from factloom.llm import license as lic

from .test_license import words

# Licences that the first nine templates did not hold.
TEXTS = {
    "all-rights-reserved": "Copyright (c) 2019 Some One. All rights reserved. Do not copy.",
    "mit-warranty": 'x y z THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE',
    "bsd-clauses": "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation",
    "agpl-notice": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_text_gets_a_row(name):
    assert name in {r[0] for r in lic.scan_words(words(TEXTS[name]), lic.Index(lic.TEMPLATES), 0.6)}


def test_three_words_are_found_beside_any_neighbours():
    index = lic.Index(lic.TEMPLATES)
    for i in range(300):
        w = words(f"a{i} b{i} all rights reserved c{i} d{i}")
        assert [r[3:] for r in lic.scan_words(w, index, 0.6) if r[0] == "all-rights-reserved"] == [(2, 5)]


def test_whole_mit_text_counts_as_whole():
    got = {r[0]: r[2] for r in lic.scan_words(words(lic.TEMPLATES["mit-text"]), lic.Index(lic.TEMPLATES), 0.6)}
    assert got["mit-text"] == 1 and "bsd-2-text" not in got

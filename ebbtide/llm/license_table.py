"""License texts and notices as rows (template, text); a template may have several wordings.

`license_texts/` has the full texts that Debian ships, by file name. Fixed values:
the others are as their publishers or common use word them.
"""

from __future__ import annotations

from pathlib import Path

FULL_TEXTS = Path(__file__).parent / "license_texts"

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_1 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. """
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission. """
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = "ermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA
OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

TEXTS = [
    ("MIT-warranty", _AS_IS),
    ("BSD-2-Clause", _BSD_1 + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD_1 + _BSD_3 + _BSD_AS_IS),
    ("ISC", f"P{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_AS_IS}"),
    ("0BSD", f"P{_ISC}. {_ISC_AS_IS}"),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of
this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
to the following restrictions"""),
    ("MPL-2.0-notice", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
obtain one at"""),
    *((f"{short}-{n}.0-or-later", f"""you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software
Foundation, either version {n} of the License, or (at your option) any later version.""") for short, name, n in
      (("GPL", "", "2"), ("LGPL", "Lesser ", "3"), ("AGPL", "Affero ", "3"))),
    ("LGPL-2.1-or-later", """you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation,
either version 2.1 of the License, or (at your option) any later version."""),
    ("All-rights-reserved", "All rights reserved"),
    ("All-rights-reserved", "Alle Rechte vorbehalten"),
    ("All-rights-reserved", "Tous droits réservés"),
    ("All-rights-reserved", "Todos los derechos reservados"),
]

#: Short names that are followed or preceded by the word license.
NAMED = {"MIT-notice": ["MIT"], "ISC-notice": ["ISC"], "BSD-notice": ["BSD"], "BSD-2-Clause-notice": ["BSD 2-Clause", "2-Clause BSD", "Simplified BSD"],
         "BSD-3-Clause-notice": ["BSD 3-Clause", "3-Clause BSD", "New BSD", "Modified BSD"], "Zlib-notice": ["zlib"], "Apache-2.0-notice": ["Apache 2.0", "Apache-2"],
         "BSL-1.0-notice": ["Boost Software"]}
PHRASES = {
    "Apache-2.0-notice": ["Apache License 2.0", "Apache License, Version 2.0", "Apache License v2.0", "Apache License v2", "Apache License, Version 2"],
    "Unlicense-notice": ["under the Unlicense", "The Unlicense"],
    "MPL-1.1-notice": ["Mozilla Public License 1.1", "Mozilla Public License, version 1.1", "Mozilla Public License, v. 1.1"],
    "MPL-2.0-notice": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0"],
    "EPL-2.0-notice": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, Version 2.0"],
    "CC0-1.0-notice": ["CC0 1.0", "Creative Commons Zero"],
}
GNU = {"GPL": ("General", ("2", "3")), "LGPL": ("Lesser General", ("2.1", "3")), "AGPL": ("Affero General", ("3",))}
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
      "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
SPDX = """MIT ISC 0BSD BSD-2-Clause BSD-3-Clause Apache-2.0 MPL-1.1 MPL-2.0 EPL-2.0 Unlicense Zlib BSL-1.0 CC0-1.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only
GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later""".split()


def rows() -> list[tuple[str, str]]:
    out = [(f"{p.stem}-text", p.read_text(encoding="utf-8")) for p in sorted(FULL_TEXTS.glob("*.txt"))] + TEXTS
    out += [(name, f"{short} {word}") for name, shorts in NAMED.items() for short in shorts for word in ("License", "Licence", "licensed")]
    out += [(name, text) for name, texts in PHRASES.items() for text in texts]
    for short, (name, versions) in GNU.items():
        for v in versions:
            full, notice = f"GNU {name} Public License", f"{short}-{v if '.' in v else v + '.0'}-notice"
            out += [(notice, f"{full}{sep}{v}") for sep in (" version ", " v", " ")] + [(notice, f"{short}v{v}"), (notice, f"{short} v{v}"), (notice, f"{short} version {v}")]
    for short, name in CC.items():
        for v in CC_VERSIONS:
            out += [(f"CC-{short}-{v}-notice", f"CC {short} {v}"), (f"CC-{short}-{v}-notice", f"Creative Commons {name} {v}")]
    out += [(f"{i}-SPDX", f"SPDX-License-Identifier: {i}") for i in SPDX + [f"CC-{short}-4.0" for short in CC]]
    return out

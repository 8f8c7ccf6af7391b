"""Texts of well-known licences and the notices that stand for them.

Fixed values: the licence texts are public and must be as published. Copyright
lines are left out, as normalising drops them.
"""

from __future__ import annotations

import re

from strandflow.llm.license_published import PUBLISHED

MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""

BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

END_OF_TERMS = "END OF TERMS AND CONDITIONS"


def forms(text: str) -> tuple[str, ...]:
    """The text as published and with each paragraph on one line, both with and without what follows its terms.

    Lines that begin with "copyright" are left out of the canonical form, and
    which ones do depends on the line breaks.
    """
    head, _, rest = text.partition(END_OF_TERMS)
    parts = (text, head + END_OF_TERMS) if rest else (text,)
    return tuple(dict.fromkeys(x for t in parts for x in (t, re.sub(r"(?<!\n)\n[ \t]*(?=\S)", " ", t))))


#: (licence, text): the text as published, and without its title line.
FULL = (
    ("MIT", MIT),
    ("MIT", MIT.split("\n", 1)[1]),
    ("ISC", ISC),
    ("ISC", ISC.split("\n", 1)[1]),
    ("BSD-2-Clause", "\n\n".join((BSD_HEAD, BSD_TAIL))),
    ("BSD-3-Clause", "\n\n".join((BSD_HEAD, BSD_NAMES, BSD_TAIL))),
    ("0BSD", ZERO_BSD),
    ("Zlib", ZLIB),
    *((name, form) for name, text in PUBLISHED for form in forms(text)),
)

#: The Creative Commons licences: their elements, and these in words.
ELEMENTS = (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
#: Their versions, and the word that may follow each.
VERSIONS = (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International"))


def commons() -> tuple[tuple[str, tuple[str, ...]], ...]:
    """The Creative Commons licences by version, with their names in letters, in words, and both."""
    out = []
    for version, kind in VERSIONS:
        for short, words in ELEMENTS:
            stems = dict.fromkeys((f"CC {short}", f"Creative Commons {words}", f"Creative Commons {words.replace('NoDerivatives', 'NoDerivs')}"))
            names = [f"{s} {version}{k}{e}" for s in stems for k in ("", f" {kind}") for e in ("", " License")]
            names += [f"{n} (CC {short} {version})" for n in names if "Attribution" in n]
            out.append((f"CC-{short}-{version}", tuple(names)))
    return tuple(out)


#: Licences that are named in notices, with the names they go by.
NAMED = (
    ("MIT", ("MIT License", "MIT")),
    ("ISC", ("ISC License", "ISC")),
    ("0BSD", ("BSD Zero Clause License", "0BSD License", "0BSD")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "BSD 2-Clause")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "BSD 3-Clause")),
    ("Zlib", ("zlib License", "zlib")),
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache-2.0 License", "Apache 2.0")),
    ("GPL-2.0", ("GNU General Public License v2.0", "GNU General Public License, version 2", "GNU General Public License 2.0", "GNU GPL v2", "GNU GPLv2", "GPL v2", "GPLv2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later")),
    ("GPL-3.0", ("GNU General Public License v3.0", "GNU General Public License, version 3", "GNU General Public License 3.0", "GNU GPL v3", "GNU GPLv3", "GPL v3", "GPLv3", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later")),
    ("LGPL-2.0", ("GNU Library General Public License, version 2", "GNU Library General Public License v2.0", "LGPL-2.0", "LGPL-2.0-only", "LGPL-2.0-or-later")),
    ("LGPL-2.1", ("GNU Lesser General Public License v2.1", "GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPL v2.1", "LGPLv2.1", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later")),
    ("LGPL-3.0", ("GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL v3", "LGPLv3", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later")),
    ("MPL-2.0", ("Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "MPL 2.0")),
    ("CC0-1.0", ("CC0 1.0 Universal", "CC0 1.0", "CC0", "CC0 License", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal License", "Creative Commons Zero")),
    *commons(),
)
VERBS = ("Released under", "Licensed under", "Distributed under", "Available under", "This work is licensed under")
PHRASES = (*(f"{verb} {article}{{}}" for verb in VERBS for article in ("the ", "a ", "")), "SPDX-License-Identifier: {}")

#: Spellings that licence texts may use for one another, the second standing for both.
EQUIVALENT = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("per cent", "percent"),
)

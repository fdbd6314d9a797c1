"""Licence wording, label by label: whole short licences, how longer ones begin and the notices they ask for, and common sentences.

Fixed values: the texts are those that the licences' publishers give out.
"""

_GNU_END = """{thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have
received a copy of the GNU {name} along with this {what}; if not, see http www gnu org licenses"""


def _gnu(name: str, versions: tuple[str, ...], what: str) -> list[str]:
    """The notices of one of the GNU licences, by version."""
    thing = {"program": "This program", "library": "This library"}[what]
    return [
        f"{thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
        f"the Free Software Foundation; either version {v} of the License, or (at your option) any later version. "
        + _GNU_END.format(thing=thing, name=name, what=what)
        for v in versions
    ]


_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""

_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http www apache org licenses LICENSE 2.0. Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""

_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at http mozilla org MPL 2.0"""

_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or
authors of this software dedicate any and all copyright interest in the software to the public domain. We make this
dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this
dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
copyright law."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution."""

_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire
statement, including the above license grant, this restriction and the following disclaimer, must be included in all
copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative
works are solely in the form of machine-executable object code generated by a source language processor."""

_WTFPL = """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing
it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR
COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."""

_CC0 = """To the extent possible under law, the person who associated CC0 with this work has waived all copyright and
related or neighboring rights to this work."""


def _cc(kind: str) -> str:
    return f"This work is licensed under a Creative Commons {kind} 4.0 International License"


def _gnu_start(name: str, version: str) -> str:
    """How the text of one of the GNU licences itself begins."""
    return (
        f"GNU {name} Version {version} Copyright Free Software Foundation Inc Everyone is permitted to copy and distribute verbatim copies "
        "of this license document but changing it is not allowed"
    )


_GPL_PREAMBLE = """The licenses for most software are designed to take away your freedom to share and change it. By contrast,
the GNU General Public License is intended to guarantee your freedom to share and change free software to make sure the
software is free for all its users. This General Public License applies to most of the Free Software Foundation's
software and to any other program whose authors commit to using it"""
_GPL3_PREAMBLE = """The GNU General Public License is a free, copyleft license for software and other kinds of works"""
_AGPL_PREAMBLE = """The GNU Affero General Public License is a free, copyleft license for software and other kinds of works,
specifically designed to ensure cooperation with the community in the case of network server software"""
_LGPL_PREAMBLE = """the GNU General Public Licenses are intended to guarantee your freedom to share and change free software to
make sure the software is free for all its users. This license, the Lesser General Public License, applies to some
specially designated software packages typically libraries of the Free Software Foundation and other authors who decide
to use it"""
_LGPL3_START = """This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of
the GNU General Public License, supplemented by the additional permissions listed below"""
_APACHE_START = """Apache License Version 2.0, January 2004 http www apache org licenses TERMS AND CONDITIONS FOR USE,
REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and
distribution as defined by Sections 1 through 9 of this document"""
_MPL_START = """Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity
that creates, contributes to the creation of, or owns Covered Software"""
_MPL1 = """The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use
this file except in compliance with the License. You may obtain a copy of the License at http www mozilla org MPL.
Software distributed under the License is distributed on an "AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express
or implied. See the License for the specific language governing rights and limitations under the License."""
_CC0_START = """CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS
DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP"""
_CC0_PURPOSE = """a Work for the purpose of contributing to a commons of creative, cultural and scientific works (Commons)
that the public can reliably and without fear of later claims of infringement build upon, modify, incorporate in other
works, reuse and redistribute as freely as possible"""


TEMPLATES: list[tuple[str, str]] = [
    *(("gpl", t) for t in _gnu("General Public License", ("2", "3"), "program")),
    *(("lgpl", t) for t in _gnu("Lesser General Public License", ("2.1", "3"), "library")),
    *(("lgpl", t) for t in _gnu("Library General Public License", ("2",), "library")),
    *(("agpl", t) for t in _gnu("Affero General Public License", ("3",), "program")),
    ("apache", _APACHE),
    ("mit", _MIT),
    ("bsd", f"{_BSD_START} {_BSD_END}"),
    ("bsd", f"{_BSD_START} {_BSD_THIRD} {_BSD_END}"),
    ("isc", _ISC),
    ("mpl", _MPL),
    ("unlicense", _UNLICENSE),
    ("zlib", _ZLIB),
    ("bsl", _BOOST),
    ("wtfpl", _WTFPL),
    ("cc0", _CC0),
    *(("gpl", _gnu_start("GENERAL PUBLIC LICENSE", v)) for v in ("2 June 1991", "3 29 June 2007")),
    *(("lgpl", _gnu_start("LESSER GENERAL PUBLIC LICENSE", v)) for v in ("2.1 February 1999", "3 29 June 2007")),
    ("lgpl", _gnu_start("LIBRARY GENERAL PUBLIC LICENSE", "2 June 1991")),
    ("agpl", _gnu_start("AFFERO GENERAL PUBLIC LICENSE", "3 19 November 2007")),
    ("gpl", _GPL_PREAMBLE),
    ("gpl", _GPL3_PREAMBLE),
    ("agpl", _AGPL_PREAMBLE),
    ("lgpl", _LGPL_PREAMBLE),
    ("lgpl", _LGPL3_START),
    ("apache", _APACHE_START),
    ("mpl", _MPL_START),
    ("mpl", _MPL1),
    ("cc0", _CC0_START),
    ("cc0", _CC0_PURPOSE),
    ("cc-by", _cc("Attribution")),
    ("cc-by-sa", _cc("Attribution ShareAlike")),
    ("cc-by-nc", _cc("Attribution NonCommercial")),
    ("cc-by-nd", _cc("Attribution NoDerivatives")),
    ("cc-by-nc-sa", _cc("Attribution NonCommercial ShareAlike")),
    ("cc-by-nc-nd", _cc("Attribution NonCommercial NoDerivatives")),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-nc", "licensed under CC BY NC 4.0"),
    ("cc-by-sa", "licensed under CC BY SA 4.0"),
    ("gpl", "this work is licensed under the GNU General Public License version 3"),
    ("mit", "released under the MIT license"),
    ("apache", "licensed under the Apache license version 2.0"),
    *((label, f"SPDX License Identifier {tag}") for label, tag in (
        ("mit", "MIT"), ("apache", "Apache 2.0"), ("gpl", "GPL 2.0"), ("gpl", "GPL 3.0"), ("lgpl", "LGPL 2.1"), ("lgpl", "LGPL 3.0"), ("agpl", "AGPL 3.0"),
        ("mpl", "MPL 2.0"), ("bsd", "BSD 2 Clause"), ("bsd", "BSD 3 Clause"), ("isc", "ISC"), ("unlicense", "Unlicense"), ("zlib", "Zlib"), ("bsl", "BSL 1.0"), ("cc0", "CC0 1.0"),
    )),
]

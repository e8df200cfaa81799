"""Minimal pairs: for each rule a source that it finds (so many times) and one that it leaves."""

from __future__ import annotations

PAGE = '<html lang="en"><head><meta charset="utf-8"><title>T</title></head><body>{}</body></html>'
BAR = '<nav><a href="/a">Alpha</a><a href="/b">Beta</a></nav>'

#: rule -> (extension, found, times, left)
CASES: dict[str, tuple[str, str, int, str]] = {
    "aria/dialog-role-missing": ("html", '<div class="modal" tabindex="-1" aria-label="x" aria-hidden="true"></div>', 1, '<div class="modal" role="dialog" tabindex="-1" aria-label="x" aria-hidden="true"></div>'),
    "aria/dropdown-toggle-triple-aria-missing": ("html", '<a data-toggle="dropdown" href="/x">m</a>', 1, '<a data-toggle="dropdown" aria-haspopup="true" aria-controls="m" href="/x">m</a>'),
    "aria/live-region-valid": ("html", '<p aria-live="loud">x</p><p aria-live="polite" aria-hidden="true">y</p>', 2, '<p aria-live="polite" aria-atomic="true">x</p>'),
    "aria/popover-trigger-missing-haspopup": ("html", '<b data-bs-toggle="popover">x</b>', 1, '<b data-bs-toggle="popover" aria-haspopup="dialog">x</b>'),
    "aria/progressbar-value-range": ("html", '<p role="progressbar" aria-valuenow="120"></p><p role="progressbar" aria-valuenow="x"></p>', 2, '<p role="progressbar" aria-valuenow="20" aria-valuemax="30"></p><p role="progressbar"></p>'),
    "aria/required-attrs": ("html", '<p role="checkbox"></p><p role="scrollbar" aria-controls="x"></p>', 2, '<p role="checkbox" aria-checked="true"></p><p role="link"></p>'),
    "aria/redundant-role-on-host-element": ("html", '<nav role="navigation"></nav><a href="/x" role="link">x</a>', 2, '<nav></nav><a role="link">x</a><ul role="navigation"></ul>'),
    "aria/invalid-role": ("html", '<p role="chekbox banner"></p>', 1, '<p role="banner"></p>'),
    "aria/valid-attr": ("html", '<p aria-lable="x"></p>', 1, '<p aria-label="x" data-x="1"></p>'),
    "aria/labelledby-target-exists": ("html", '<p aria-labelledby="a b"></p><i id="a"></i>', 1, '<p aria-labelledby="a"></p><i id="a"></i>'),
    "aria/hidden-focus": ("html", '<div aria-hidden="true"><a href="/x">x</a><button>y</button></div>', 1, '<div aria-hidden="true"><a>x</a><a href="/x" tabindex="-1">y</a></div>'),
    "aria/tablist-on-non-tab-container": ("html", '<ul role="tablist"><li>x</li></ul>', 1, '<ul role="tablist"><li><a role="tab" href="/x">x</a></li></ul>'),
    "aria/tab-controls-missing": ("html", '<a role="tab" aria-controls="p">x</a><a role="tab">y</a><div id="p"></div>', 2, '<a role="tab" aria-controls="p">x</a><div role="tabpanel" id="p"></div>'),
    "aria/presentation-on-semantic-ancestor": ("html", '<ul role="presentation"><li>x<li>y</ul>', 1, '<ul><li>x</ul><table role="none"><tr><td>y</td></tr></table>'),
    "document/charset-first-1024-bytes": ("html", '<html><head><title>x</title><meta charset="utf-8"></head></html>', 1, '<html><head><meta charset="utf-8"><title>x</title></head></html>'),
    "document/iframe-title": ("html", '<iframe src="/x"></iframe>', 1, '<iframe src="/x" title="Map"></iframe><iframe aria-hidden="true"></iframe>'),
    "document/lang-attribute": ("html", "<html><body>x</body></html>", 1, '<html lang="de"><body>x</body></html>'),
    "document/lang-on-parts": ("html", '<p lang="en_US">x</p>', 1, '<p lang="en-US">x</p>'),
    "document/meta-refresh": ("html", '<meta http-equiv="refresh" content="5; url=/x"><meta http-equiv="refresh" content="0">', 2, '<meta http-equiv="refresh" content="x">'),
    "document/page-titled": ("html", "<html><head><title> </title></head></html>", 1, "<html><head><title>Home</title></head></html>"),
    "document/viewport-zoom": ("html", '<meta name="viewport" content="user-scalable=no, maximum-scale=1">', 2, '<meta name="viewport" content="width=device-width, maximum-scale=3">'),
    "focus/tabindex-positive": ("html", '<p tabindex="2">x</p>', 1, '<p tabindex="0">x</p><p tabindex="-1">y</p>'),
    "forms/aria-invalid-missing": ("html", '<input class="is-invalid">', 1, '<input class="is-invalid" aria-invalid="true">'),
    "forms/autocomplete-missing": ("html", '<input type="email"><input name="user_firstname">', 2, '<input type="email" autocomplete="email"><input name="colour">'),
    "forms/fieldset-legend": ("html", "<fieldset><legend> </legend></fieldset>", 1, "<fieldset><legend>Size</legend></fieldset>"),
    "forms/label-adjacent-mismatch": ("html", '<div><label for="b">x</label><input id="a"></div><input id="b">', 1, '<div><label for="a">x</label><input id="a"></div>'),
    "forms/label-adjacent-unassociated": ("html", "<div><label>Name</label><input></div>", 1, '<div><label for="a">Name</label><input id="a"></div>'),
    "forms/label-for-id-mismatch": ("html", '<label for="A">x</label><input id="a">', 1, '<label for="a">x</label><input id="a">'),
    "forms/labels-required": ("html", '<input><select></select><input type="submit">', 2, '<label>x<input></label><label for="s">y</label><select id="s"></select>'),
    "forms/placeholder-as-label": ("html", '<input placeholder="Name">', 1, '<input placeholder="Name" aria-label="Name">'),
    "forms/value-as-label": ("html", '<input value="Name">', 1, '<input value="12"><input value="x" title="y">'),
    "forms/multiple-label-for-same-id": ("html", '<label for="a">x</label><label for="a">y</label><input id="a">', 1, '<label for="a">x</label><input id="a">'),
    "forms/no-submit-control": ("html", "<form><input></form>", 1, "<form><input><button>Go</button></form>"),
    "forms/non-empty-label": ("html", "<label> </label>", 1, "<label>x</label>"),
    "forms/radio-group-without-fieldset": ("html", '<input type="radio" name="r"><input type="radio" name="r">', 1, '<fieldset><legend>Size</legend><input type="radio" name="r"><input type="radio" name="r"></fieldset>'),
    "forms/submit-not-button-or-input": ("html", '<form><a class="btn" href="/x">Go</a></form>', 1, '<form><a class="btn" href="/x">Go</a><input type="submit"></form>'),
    "keyboard/accesskey-duplicate": ("html", '<a accesskey="s">x</a><b accesskey="S">y</b>', 1, '<a accesskey="s">x</a><b accesskey="t">y</b>'),
    "keyboard/anchor-button-not-focusable": ("html", '<a class="btn">x</a>', 1, '<a class="btn" href="/x">x</a>'),
    "keyboard/handler-missing": ("html", '<div onclick="f()">x</div>', 1, '<div onclick="f()" onkeydown="f()">x</div><button onclick="f()">y</button>'),
    "media/alt-text-missing": ("html", '<img src="a.png"><canvas></canvas>', 2, '<img src="a.png" alt=""><img title="x"><canvas>text</canvas>'),
    "media/alt-text-placeholder": ("html", '<img alt="Image"><img alt="IMG_1234">', 2, '<img alt="A red door">'),
    "media/audio-video-no-controls": ("html", "<audio></audio>", 1, "<audio controls></audio>"),
    "media/autoplay-sound": ("html", "<video autoplay></video>", 1, "<video autoplay muted></video>"),
    "media/video-captions-missing": ("html", "<video controls></video>", 1, '<video controls><track kind="captions"></video>'),
    "motion/pause-stop-hide": ("html", "<marquee>x</marquee>", 1, "<p>x</p>"),
    "navigation/href-empty-fragment": ("html", '<a href="#">x</a><a href=" ">y</a>', 2, '<a href="#x">x</a><a>y</a>'),
    "navigation/href-javascript-scheme": ("html", '<a href="JavaScript:void(0)">x</a>', 1, '<a href="/javascript">x</a>'),
    "navigation/in-page-link-fragment-missing": ("html", '<a href="#b">x</a><p id="a"></p>', 1, '<a href="#a">x</a><a href="#top">y</a><p id="a"></p>'),
    "navigation/link-descriptive-text": ("html", '<a href="/x">Click here</a><a href="/y">Read more »</a><a href="/z"></a>', 3, '<a href="/x">Prices</a><a href="/y"><img alt="Home"></a>'),
    "navigation/link-name-only-symbol": ("html", '<a href="/x">»</a>', 1, '<a href="/x" aria-label="Next">»</a>'),
    "navigation/link-no-href": ("html", '<a onclick="f()">x</a>', 1, '<a onclick="f()" href="/x">x</a>'),
    "navigation/link-target-blank-announcement": ("html", '<a href="/x" target="_blank">Prices</a>', 1, '<a href="/x" target="_blank">Prices (opens in new tab)</a>'),
    "navigation/skip-link": ("html", PAGE.format(BAR), 1, PAGE.format('<a href="#m">Skip</a>' + BAR + '<main id="m"></main>')),
    "parsing/duplicate-id": ("html", '<p id="a"></p><p id="a"></p><p id="A"></p>', 1, '<p id="a"></p><p id="b"></p>'),
    "parsing/html-has-lang": ("html", '<p lang="english-language-x">x</p>', 1, '<p lang="en">x</p>'),
    "parsing/invalid-id-shape": ("html", '<p id="a b"></p><p id></p>', 2, '<p id="1-a_b"></p>'),
    "parsing/malformed-tag": ("html", "<h7>x</h7>", 1, "<h6>x</h6>"),
    "pointer/cancellation": ("html", '<b onmousedown="f()">x</b>', 1, '<b onmousedown="f()" onmouseup="g()">x</b>'),
    "pointer/draggable-no-keyboard-alt": ("html", '<b draggable="true">x</b>', 1, '<b draggable="true" onkeydown="f()">x</b>'),
    "pointer/stretched-link-multiple-in-container": ("html", '<div class="card"><a class="stretched-link">x</a><a class="stretched-link">y</a></div>', 1, '<div class="card"><a class="stretched-link">x</a></div>'),
    "semantics/button-name": ("html", '<button></button><input type="image" src="x">', 2, '<button><img alt="Save"></button><button>Go</button>'),
    "semantics/button-name-only-symbol": ("html", "<button>×</button>", 1, "<button>Close</button>"),
    "semantics/duplicate-landmark-unlabeled": ("html", "<nav>x</nav><nav>y</nav>", 2, '<nav aria-label="a">x</nav><aside>y</aside>'),
    "semantics/empty-heading": ("html", "<h2> </h2>", 1, '<h2><img alt="x"></h2><h3>y</h3>'),
    "semantics/form-landmark-name-missing": ("html", "<form>x</form>", 1, '<form aria-label="Search">x</form>'),
    "semantics/heading-class-on-nonheading": ("html", '<p class="h2">x</p>', 1, '<h2 class="h2">x</h2>'),
    "semantics/heading-hierarchy": ("html", "<h1>a</h1><h3>b</h3><h1>c</h1>", 2, "<h1>a</h1><h2>b</h2><h3>c</h3><h2>d</h2>"),
    "semantics/inline-display-none-on-focusable": ("html", '<div style="display: none"><button>x</button></div>', 1, '<div style="display: none"><p>x</p></div>'),
    "semantics/interactive-ancestor-of-heading": ("html", '<a href="/x"><h2>x</h2></a>', 1, '<h2><a href="/x">x</a></h2>'),
    "semantics/label-in-name": ("html", '<button aria-label="Submit form">Send</button>', 1, '<button aria-label="Send form">Send</button>'),
    "semantics/landmark-main": ("html", PAGE.format(BAR), 1, PAGE.format(BAR + "<main>x</main>")),
    "semantics/layout-table-no-presentation-role": ("html", "<table><tr><td>x</td></tr></table>", 1, '<table role="presentation"><tr><td>x</td></tr></table>'),
    "semantics/list-structure": ("html", "<div><li>x</li></div><ul><p>y</p></ul>", 2, "<ul><li>x<li>y</ul>"),
    "semantics/nested-interactive": ("html", '<a href="/x"><button>y</button></a>', 1, '<details><a href="/x">y</a></details>'),
    "semantics/section-accessible-name-missing": ("html", "<body><section><p>x</p></section></body>", 1, "<body><section><h2>x</h2></section></body>"),
    "semantics/svg-title-missing": ("html", "<svg></svg>", 1, '<svg><title>x</title></svg><svg aria-hidden="true"></svg>'),
    "semantics/table-caption-missing": ("html", "<table><tr><th>x</th></tr></table>", 1, "<table><caption>c</caption><tr><th>x</th></tr></table>"),
    "semantics/table-headers": ("html", "<table><tr><td><table><tr><th>x</th></tr></table></td></tr></table>", 1, "<table><tr><th>x</th><td>y</td></tr></table>"),
    "semantics/visual-disabled-non-control": ("html", '<span class="disabled">x</span>', 1, '<span class="disabled" aria-disabled="true">x</span>'),
    "tooltip/dismissable": ("html", '<button title="Save the file">Save</button>', 1, '<button title="Save">Save</button><p title="x">y</p>'),
    "aria/icon-font-hidden": ("html", '<i class="fa fa-home"></i>', 1, '<i class="fa fa-home" aria-hidden="true"></i><i>fa</i>'),
    "aria/expanded-on-disclosure": ("html", '<button data-bs-toggle="collapse">x</button>', 1, '<button data-bs-toggle="collapse" aria-expanded="false" aria-controls="c">x</button>'),
    "aria/role-from-class-only": ("html", '<div class="alert alert-danger">Disk full</div>', 1, '<div class="alert alert-danger" role="alert">Disk full</div><div class="alert">Error: disk full</div>'),
    "forms/select-onchange-context-change": ("html", '<select onchange="location.href=this.value"></select>', 1, '<select onchange="show(this.value)"></select>'),
    "semantics/table-th-scope-missing": ("html", "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", 2, '<table><tr><th scope="col">a</th><th scope="col">b</th></tr><tr><td>1</td><td>2</td></tr></table><table><tr><th>a</th></tr><tr><td>1</td></tr></table>'),
    "media/img-empty-alt-in-clickable-group": ("html", '<a href="/x"><img alt=""></a>', 1, '<a href="/x"><img alt="">Home</a>'),
    "media/svg-accessible-name": ("html", "<button><svg></svg></button>", 1, '<button><svg><title>Save</title></svg></button><button aria-label="x"><svg></svg></button>'),
    "forms/asterisk-required-marker": ("html", '<label for="a">Name *</label><input id="a">', 1, '<label for="a">Name *</label><input id="a" required>'),
    "pointer/drag-alternative": ("html", '<p draggable="true">x</p>', 1, '<p draggable="true">x</p><button onclick="f()">Move</button>'),
    "color/state-class-color-only": ("css", ".is-error { color: red }", 1, ".is-error { color: red; font-weight: bold }"),
    "contrast/minimum": ("css", "p { color: #777777; background: #fff }", 1, "p { color: #767676; background: #fff } h1 { color: #777; background: #fff; font-size: 24px }"),
    "contrast/enhanced": ("css", ":root { --c: #666 } p { color: var(--c); background: #fff }", 1, "p { color: #595959; background: #fff }"),
    "contrast/non-text": ("css", "button { border-color: #ddd; background: #fff }", 1, "button { border-color: #000; background: #fff }"),
    "focus/not-obscured": ("css", ".bar { position: fixed; top: 0 }", 1, "html { scroll-padding-top: 4rem } .bar { position: fixed; top: 0 }"),
    "focus/outline-visible": ("css", "a:focus { outline: none }", 1, "a:focus { outline: none; box-shadow: 0 0 2px blue }"),
    "keyboard/hover-only-no-focus-mirror": ("css", ".m:hover { display: block }", 1, ".m:hover { display: block } .m:focus { display: block }"),
    "layout/horizontal-scroll-no-keyboard": ("css", ".t { overflow-x: auto; overflow: auto }", 1, ".t { overflow: hidden }"),
    "layout/orientation-lock": ("css", "@media (orientation: portrait) { .a { display: none } }", 1, "@media (min-width: 1px) { .a { display: none } }"),
    "layout/reflow-hardcoded-width": ("css", ".a { width: 900px } .b { min-width: 20cm }", 2, ".a { width: 300px; max-width: 900px } body { width: 900px }"),
    "layout/text-spacing": ("css", "p { line-height: 1.2 !important }", 1, "p { line-height: 1.2; color: red !important }"),
    "motion/animation-from-interactions": ("css", "a:hover { transition: all 1s }", 1, "a:hover { transition: all 1s } @media (prefers-reduced-motion: reduce) { a { color: red } }"),
    "pointer/target-size": ("css", ".btn { width: 20px; height: 30px }", 1, ".btn { width: 24px } .x { width: 2px }"),
    "pointer/target-size-enhanced": ("css", ".btn { width: 40px }", 1, ".btn { width: 44px }"),
    "aria/conflicting-role": ("html", '<a href="/x" role="button">x</a><h2 role="tab">y</h2>', 2, '<a role="button">x</a><h2 role="none">y</h2><nav role="navigation"></nav>'),
    "aria/disabled-link-surrogate": ("html", '<p><a href="/x">1</a><span class="next">2</span></p>', 1, '<p><a href="/x">1</a><span class="next" aria-disabled="true">2</span></p><p><b class="disabled">x</b></p>'),
    "aria/icon-child-missing-aria-hidden": ("html", '<button><i class="fa fa-x"></i></button>', 1, '<button><i class="fa fa-x" aria-hidden="true"></i></button><button>Close <i class="fa fa-x"></i></button>'),
    "aria/tab-widget-roles": ("html", '<ul role="tablist"><li><a href="#p" data-bs-toggle="tab">x</a></li></ul><div id="p"></div>', 2, '<ul role="tablist"><li><a href="#p" role="tab" aria-selected="true">x</a></li></ul><div id="p" role="tabpanel"></div>'),
    "color/meaning-by-color-only": ("html", '<p class="text-danger">12 %</p>', 1, '<p class="text-danger">Failed: 12 %</p><p class="text-danger"><svg></svg>12 %</p><div role="status"><p class="text-danger">3</p></div>'),
    "forms/error-message-not-associated": ("html", '<div><input><p class="invalid-feedback" id="e">No</p></div>', 1, '<div><input aria-describedby="d e"><p class="invalid-feedback" id="e">No</p></div>'),
    "forms/required-marker-without-required-attr": ("html", '<label for="a">Name <span>*</span></label><input id="a">', 1, '<label for="a">Name <span>*</span></label><input id="a" required><label for="b">Age</label><input id="b">'),
    "media/audio-controls-or-transcript-missing": ("html", '<div><p><audio src="x"></audio></p></div>', 1, '<div><p><audio src="x"></audio></p><a href="/t">Transcript</a></div><audio controls></audio>'),
    "aria/live-region-missing-on-innerhtml-target": ("html", '<p id="total">0</p><script>setInterval(f, 9); document.getElementById("total").textContent = x;</script>', 1, '<p id="sum" role="status">0</p><script>setInterval(f, 9); document.getElementById("sum").textContent = x;</script>'),
    "keyboard/interactive-div-role-missing": ("html", '<div id="opener">x</div><script>document.getElementById("opener").addEventListener("click", f)</script>', 1, '<button id="closer">x</button><script>document.getElementById("closer").addEventListener("click", f)</script>'),
    "keyboard/character-shortcuts": ("js", 'document.addEventListener("keydown", e => {\n  if (e.key === "s") save();\n});', 1, 'document.addEventListener("keydown", e => {\n  if (e.ctrlKey && e.key === "s") save();\n});'),
    "forms/required-indicator-missing": ("tsx", "export const F = ({required}) => <label>Name<input required={required} /></label>;", 1, "export const F = ({required}) => <label>Name {required && '*'}<input required={required} /></label>;"),
}

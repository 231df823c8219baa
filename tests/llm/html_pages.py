"""Pages written by hand in the manner of common systems, with their articles; no generator made them."""

BLOG = (
    """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Sourdough | Kitchen Notes</title><style>p{margin:0}</style></head>
<body class="post-template single"><a class="skip-link" href="#content">Skip to content</a><header id="masthead" class="site-header"><p class="site-title"><a href="/">Kitchen Notes</a></p>
<nav id="site-navigation" class="main-navigation"><ul id="primary-menu" class="menu"><li class="menu-item"><a href="/">Home</a></li><li class="menu-item"><a href="/about">About</a></li></ul></nav></header>
<div id="content" class="site-content"><main id="main" class="site-main"><article id="post-12" class="post-12 post hentry"><h1 class="entry-title">Keeping a sourdough starter alive</h1>
<div class="entry-content"><p>A starter is flour and water that has been left alone for long enough. Feed it every day, and it will rise within hours.</p>
<h2>What you need</h2><ul><li>Strong white flour, about a kilogram.</li><li>Water at room temperature.</li></ul>
<p>On the third day it smells sour. That is how it should be; do not throw it away.</p><div class="sharedaddy sd-sharing"><h3>Share this:</h3><ul><li><a href="#">Twitter</a></li><li><a href="#">Facebook</a></li></ul></div></div></article>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on this</h2><ol class="comment-list"><li class="comment"><p>Mine died last week, so thank you for this.</p></li><li class="comment"><p>Rye flour works better, I think.</p></li></ol></div></main>
<aside id="secondary" class="widget-area"><section class="widget widget_recent"><h2 class="widget-title">Recent Posts</h2><ul><li><a href="/p/1">Pickled beets</a></li><li><a href="/p/2">A week of soups</a></li></ul></section></aside></div>
<footer id="colophon" class="site-footer"><p>Proudly made at home. All rights reserved.</p></footer></body></html>""",
    "Keeping a sourdough starter alive\nA starter is flour and water that has been left alone for long enough. Feed it every day, and it will rise within hours.\nWhat you need\nStrong white flour, about a kilogram.\nWater at room temperature.\nOn the third day it smells sour. That is how it should be; do not throw it away.",
)

NEWS = (
    """<html><body><div class="top-bar"><a href="/login">Sign in</a> <a href="/subscribe">Subscribe</a></div><div class="nav-wrapper"><ul class="nav"><li><a href="/w">World</a></li><li><a href="/b">Business</a></li><li><a href="/s">Sport</a></li></ul></div>
<div class="breadcrumb"><a href="/">Home</a> &gt; <a href="/w">World</a></div><div class="page"><div class="column main-column"><div class="story" itemprop="articleBody"><h1>River floods force hundreds from their homes</h1>
<p>Heavy rain over three days has pushed the river above its banks, and more than four hundred people spent the night in schools.</p><p>&ldquo;We took what we could carry,&rdquo; said one of them. Nobody was hurt, according to the council.</p>
<div class="advertisement"><p>Advertisement</p><p>New tyres at half the price. Order today!</p></div><p>The water is expected to fall by Friday, when the bridges will be inspected.</p></div>
<div class="related"><h3>Related stories</h3><ul><li><a href="/1">Why the dam was never built</a></li><li><a href="/2">Rain in numbers</a></li></ul></div></div>
<div class="column side-column"><div class="most-popular"><h3>Most popular</h3><ol><li><a href="/3">Lost dog walks home</a></li><li><a href="/4">Ten quiet beaches</a></li></ol></div></div></div>
<div class="cookie-banner"><p>We value your privacy. We and our partners store cookies on your device.</p><button>Accept</button></div><div class="footer"><p>&copy; 2020 The Paper Ltd.</p><a href="/terms">Terms</a></div></body></html>""",
    "River floods force hundreds from their homes\nHeavy rain over three days has pushed the river above its banks, and more than four hundred people spent the night in schools.\n“We took what we could carry,” said one of them. Nobody was hurt, according to the council.\nThe water is expected to fall by Friday, when the bridges will be inspected.",
)

OLD = (
    """<HTML><HEAD><TITLE>On bees</TITLE></HEAD><BODY BGCOLOR="#FFFFFF"><TABLE WIDTH="100%"><TR><TD CLASS="nav"><A HREF="a.htm">Index</A><BR><A HREF="b.htm">Links</A><BR><A HREF="c.htm">Guest book</A></TD>
<TD CLASS="content"><H1>On bees</H1><P>A hive holds some forty thousand bees in summer, nearly all of them sisters.<P>In winter they form a ball, and take turns at being outside. The queen stays in the middle, where it is warm.
<P>Honey keeps for years.</TD></TR></TABLE><HR><ADDRESS CLASS="footer">Last changed in May. <A HREF="mailto:x@example.org">Mail me</A></ADDRESS></BODY></HTML>""",
    "On bees\nA hive holds some forty thousand bees in summer, nearly all of them sisters.\nIn winter they form a ball, and take turns at being outside. The queen stays in the middle, where it is warm.\nHoney keeps for years.",
)

DOCS = (
    """<body><header class="navbar"><a href="/">lib</a><form class="search" role="search"><input name="q"><button>Search</button></form></header><div class="layout"><nav class="toc"><ul><li><a href="#i">Install</a></li><li><a href="#u">Use</a></li></ul></nav>
<main role="main"><section id="i"><h1>Install</h1><p>The library needs a compiler. Run the command below in a shell, and wait for it to end.</p><pre>make install</pre></section><section id="u"><h2>Use</h2><p>Open a file, read its lines, and close it again. Errors are raised, never returned.</p>
<math><mi>a</mi><mo>+</mo><mi>b</mi></math><table><tr><th>Name</th><th>Meaning</th></tr><tr><td>path</td><td>Where the file is.</td></tr></table></section></main></div><footer><p>Built with care. <a href="/license">License</a></p></footer></body>""",
    "Install\nThe library needs a compiler. Run the command below in a shell, and wait for it to end.\nmake install\nUse\nOpen a file, read its lines, and close it again. Errors are raised, never returned.\na+b\nName\nMeaning\npath\nWhere the file is.",
)

RECIPE = (
    """<body><div id="header"><div class="logo">Plain Food</div><div id="menu"><a href="/r">Recipes</a><a href="/t">Tips</a></div></div><div class="newsletter-popup"><h4>Join us!</h4><p>Get a recipe every week by mail.</p><input type="email"></div>
<div id="wrapper"><div id="article-body"><h1>Barley soup</h1><p class="intro">A soup for cold days, ready in an hour. It is better on the next day.</p><h3>Method</h3><ol><li>Wash the barley and let it soak.</li><li>Fry the onions slowly, until they are golden.</li><li>Add water, and boil for forty minutes.</li></ol>
<p>Serve it with bread.</p></div><div class="sponsored-box"><p>Sponsored: knives that stay sharp.</p></div><div class="reviews"><h3>Reviews</h3><div class="review"><p>Far too salty for us, sorry.</p></div></div></div><div id="footer">Contact | Imprint | Privacy</div></body>""",
    "Barley soup\nA soup for cold days, ready in an hour. It is better on the next day.\nMethod\nWash the barley and let it soak.\nFry the onions slowly, until they are golden.\nAdd water, and boil for forty minutes.\nServe it with bread.",
)

PAGES = [BLOG, NEWS, OLD, DOCS, RECIPE]

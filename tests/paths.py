"""Where the test tables lie."""

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"

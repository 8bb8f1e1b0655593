"""Explicit schemas of stored tables."""

RUNS = "run_id string, goal string, spans array<struct<name:string,parent:string,span_id:string,start:double,end:double,status:string,error:string,input:string,output:string,tokens:int>>"
VECTORS = "id string, chunk int, vec array<double>, text string, meta map<string,string>"
